"""Table schemas (DDL) shared by the operators."""

from pyspark.sql import types as T

PACKETS = (
    "packet_no bigint, ts timestamp, src_ip string, dst_ip string, src_port int, dst_port int, proto string, "
    "ip_id int, ip_proto int, tcp_flags string, seq bigint, ack bigint, window int, icmp_type int, icmp_code int, "
    "payload binary"
)
CONTENT_OPTION = "struct<offset:int,depth:int,within:int,distance:int,nocase:boolean>"
BYTE_TEST = (
    "struct<bytes:int,op:string,value:decimal(20,0),offset:int,relative:boolean,endian:string,raw:string>"
)
ISDATAAT = "struct<offset:int,negated:boolean,relative:boolean,raw:string>"
RULE_METADATA = (
    f"struct<content_patterns:array<string>,content_options:array<{CONTENT_OPTION}>,"
    f"byte_tests:array<{BYTE_TEST}>,isdataat:array<{ISDATAAT}>,byte_test_only:boolean,"
    "dsize:string,flow:string,flags:string,ip_id:string,ip_proto:string,"
    "dns_query:boolean,smtp_command:boolean,pop_command:boolean,"
    "snort_sid:string,snort_rev:string,snort_gid:string,classtype:string,threshold:string,reference:string,"
    "service:string,app_layer_protocol:string,ssl_version:string,metadata:string,priority_option:string,"
    "unsupported_reason:string,raw_rule:string>"
)
RULES = (
    "rule_id string, name string, action string, priority int, protocol string, src string, "
    "src_ports array<string>, direction string, dst string, dst_ports array<string>, pattern array<string>, "
    "pattern_type string, description string, category string, tags array<string>, "
    f"metadata {RULE_METADATA}, enabled boolean"
)
AUTH_EVENTS = "packet_no bigint, ts timestamp, src_ip string, dst_ip string, success boolean, auth_type string"
ALERTS = (
    "id bigint, rule_id string, match_text string, src_ip string, dst_ip string, pos_start int, pos_end int, "
    "payload_preview string, priority int, severity string, created_at timestamp"
)
ATTACKERS = "src_ip string, severity string, first_seen timestamp, description string"


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
