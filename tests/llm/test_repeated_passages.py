"""Repeated passages: against a plain version."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from packetloom.llm import phrase_automata as pa_


def plain(rows, window):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    seen = Counter(tuple(w[p : p + window]) for w in texts for p in range(len(w) - window + 1))
    found = []
    for row, words in zip(rows, texts, strict=True):
        gone = {k for p in range(len(words) - window + 1) if seen[tuple(words[p : p + window])] > 1 for k in range(p, p + window)}
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        found.append((row[0], len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept if gone else None))
    return found


def compare(documents, rows, window=pa_.WINDOW, change=lambda df: df):
    got = pa_.remove_repeated_passages(change(documents(rows)), window).select("doc_id", "n_words", "n_removed", "kept_sha256", "kept").collect()
    key = lambda r: (r[0] is None, repr(r))
    assert sorted(map(tuple, got), key=key) == sorted(plain(rows, window), key=key)


def invented(rng, n, words=3000):
    return [f"w{k}" for k in rng.integers(0, words, n)]


def test_passages_of_odd_tables(documents, clashing):
    rng = np.random.default_rng(3)
    passages = [invented(rng, n) for n in (34, 35, 36, 60, 200)]
    rows = []
    for k in range(60):
        parts = [invented(rng, int(rng.integers(0, 50)))]
        for _ in range(int(rng.integers(0, 4))):
            passage = passages[int(rng.integers(0, 5))]
            cut = int(rng.integers(0, 20)) if len(passage) > 60 else 0
            parts += [passage[cut : len(passage) - cut], invented(rng, int(rng.integers(0, 40)))]
        rows.append((k, (" ", "\n", "\t \x0b")[k % 3].join(w for p in parts for w in p)))
    rows += [(100, None), (101, ""), (102, " \n "), (None, rows[0][1]), (103, rows[7][1]), (103, "other text"), rows[9], rows[9]]
    rows += [(104, "same " * 35), (105, "again " * 36), (106, " ".join(["a b c"] * 40)), (107, "ä ß\x1c字 " * 50)]
    rows += [(200 + k, " ".join(passages[3])) for k in range(30)]  # a passage alone, many times
    compare(documents, rows, change=clashing)
    assert pa_.remove_repeated_passages(documents([])).count() == 0


def test_very_long_texts_over_several_shards(documents, monkeypatch):
    monkeypatch.setattr(pa_, "SHARD", 20_000)
    rng = np.random.default_rng(4)
    long = invented(rng, 120_000)
    rows = [(0, " ".join(long)), (1, " ".join(long[5000:9000] + ["x"] + long[70_000:70_040])), (2, "y" * 1_000_000 + " " + " ".join(long[100:140]))]
    rows += [(k, " ".join(invented(rng, 200) + long[k : k + 50])) for k in range(3, 60)]
    compare(documents, rows)


@pytest.mark.parametrize("window", [1, 2, 4, 7])
def test_short_windows(documents, window):
    rng = np.random.default_rng(window)
    rows = [(k, " ".join("abcdef"[c] for c in rng.integers(0, 6, int(rng.integers(0, 25))))) for k in range(25)]
    compare(documents, rows, window)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "ab", "c"]), max_size=60), st.integers(5, 12))
def test_segments_cover_each_window_once(words, window):
    words = [w.encode() for w in words]
    runs = pa_.Runs(words)
    anchors, _, first, last = pa_.segments(runs, window)
    assert [p for a, b in zip(first, last, strict=True) for p in range(a, b + 1)] == list(range(max(0, len(words) - window + 1)))
    # equal windows have equal anchors
    met = {}
    for anchor, a, b in zip(anchors, first, last, strict=True):
        for p in range(a, b + 1):
            assert met.setdefault(tuple(words[p : p + window]), anchor) == anchor


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40), st.lists(st.lists(st.sampled_from("abc"), min_size=2, max_size=6), min_size=1, max_size=4))
def test_the_automaton_finds_all_phrases(words, phrases):
    compiled = {" ".join(p): (len(p) // 3, len(p) - len(p) // 3) for p in phrases}
    spans = pa_.PhraseAutomaton(compiled).spans(f" {' '.join(words)} ")
    gone = {k for p in phrases for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p for k in range(i, i + len(p))}
    removed, kept = pa_.without_spans(f" {' '.join(words)} ", spans)
    assert removed == len(gone) and kept == " ".join(w for k, w in enumerate(words) if k not in gone)
