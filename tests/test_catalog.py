"""The registered queries: complete, and a selection against their SQL."""

import subprocess
import sys
from pathlib import Path

import pytest

from packetloom.plans import catalog

ROOT = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.001")


def test_every_sql_belongs_to_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"t10_detect"}


@pytest.mark.skipif(not DATA.exists(), reason="test tables not present")
def test_selected_queries_agree_with_sql():
    names = ["a1_buckets_1h", "a3_top_ips", "b4_brute_force", "c1_scoring", "j3_cidr", "m2_chain", "r3_contents", "t1_handshake", "t8_alert"]
    done = subprocess.run(
        [sys.executable, "tools/check_oracles.py", "--sf", "0.001", *names], cwd=ROOT, capture_output=True, text=True, timeout=900
    )
    assert "failures: 0" in done.stdout, done.stdout[-3000:]
