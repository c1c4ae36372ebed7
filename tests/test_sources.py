"""Readers on files that are built here."""

import gzip
import io
import json
import os
import sqlite3
import struct
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.sources import arrays, catalogs, containers, delimited, detect, files, geo, jsonlines, media, office, packets, parquet, trees


def put(folder, name, content):
    path = folder / name
    path.write_bytes(content.encode() if isinstance(content, str) else content)
    return str(path)


def test_delimited(spark, tmp_path):
    assert delimited.split_cells('a"b"c,d', ",") == ["abc", "d"]
    assert delimited.split_cells('"x ""y"" z", 2 ', ",") == ['x "y" z', "2"]
    assert delimited.infer_delimiter(["id;name;first;last", "1;a;b;c"]) == ";" and delimited.infer_delimiter([], "x.tsv") == "\t" and delimited.infer_delimiter(["a"]) == ","
    df = delimited.read_delimited(spark, put(tmp_path, "n.tsv", 'title\tnote\nReport\t"Line A\tLine B"\n'))
    assert [tuple(r) for r in df.collect()] == [(0, "Report", "Line A\tLine B")]
    g = delimited.read_grid(spark, put(tmp_path, "r.csv", "a,b\n\n1\n2,3,4\n"))
    assert sorted((r["_row_index"], list(r["cells"])) for r in g.collect()) == [(1, ["1"]), (2, ["2", "3", "4"])]
    assert delimited.unique_names(["a", "A", ""]) == ["a", "A_2", "Column3"]
    with pytest.raises(ValueError, match="CSV file is empty"):
        delimited.read_delimited(spark, put(tmp_path, "e.csv", "\n \n"))
    assert delimited.read_delimited(spark, put(tmp_path, "m.csv", 'a,b\n"x\ny",2\n'), multiline=True).first()["a"] == "x\ny"


def test_lines_of_many_splits(spark, tmp_path):
    text = "".join(f"line {i}\r\n" if i % 7 else "\n" for i in range(1, 5001))
    path = put(tmp_path, "big.txt", text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = {r["line"]: r["text"] for r in files.lines(spark, path).collect()}
        assert got == {i: f"line {i}" if i % 7 else "" for i in range(1, 5001)}
        numbers = {r["line"]: r["number"] for r in files.nonblank_lines(spark, path).collect()}
        assert numbers == {i: i - i // 7 for i in range(1, 5001) if i % 7}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_json_lines(spark, tmp_path):
    path = put(tmp_path, "a.jsonl", '{"a":1}\n\noops\n3\n')
    got = jsonlines.read_jsonl(spark, path).orderBy("line_number").collect()
    assert [(r["line_number"], r["physical_line"], r["is_valid"]) for r in got] == [(1, 1, True), (2, 3, False), (3, 4, True)]
    assert tuple(jsonlines.line_counts(jsonlines.read_jsonl(spark, path)).first()) == (3, 2, 1)
    for text, ok in (('{"a":1} x', False), ("01", False), ("NaN", False), ('{"a":1,}', False), ("null", True), ('"x"', True), ('{"a":1,"a":2}', True)):
        assert jsonlines.is_json(text) is ok
    some, more = jsonlines.read_jsonl_preview(spark, path, 9)
    assert some.count() == 1 and more
    r = jsonlines.read_json(spark, put(tmp_path, "d.json", '{"a":[1]}')).select("pretty", jsonlines.value_type(F.col("v")).alias("t")).first()
    assert r["pretty"] == '{\n  "a": [\n    1\n  ]\n}' and r["t"] == "object"


def test_parquet_ranges(spark, tmp_path):
    path = str(tmp_path / "p.parquet")
    spark.range(25000).selectExpr("id", "struct(id AS x, array(1.5) AS y) AS s").coalesce(1).write.parquet(path)
    df, nxt, more = parquet.next_batch(spark, path, 10000)
    assert (df.count(), nxt, more) == (10000, 20000, True) and df.agg(F.min("id")).first()[0] == 10000
    assert parquet.leaves(spark.read.parquet(path).schema) == [("id", "bigint"), ("s.x", "bigint"), ("s.y.list.element", "decimal(2,1)")]


def test_detection(spark, tmp_path):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("xl/workbook.xml", "")
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w") as f:
        f.writestr("a.txt", "")
    cases = {
        "a.bin": (b"PAR1\0\1\2\3PAR1", "parquet", True), "b.mat": (b"\x89HDF\r\n\x1a\n", "mat", True), "c.txt": ('{"id":1}\n{"id":2}\n', "jsonl", False), "d.json": ('{"id":1,"name":"demo"}', "json", False), "e.md": ('{"id":1}', "markdown", False),
        "f": (b"%PDF-1.4", "pdf", True), "g": (b"\x89PNG\r\n\x1a\n", "image", True), "h": (b"Obj\1xx", "avro", True), "i": (b"#ROSBAG V2.0\n", "bag", True), "j": (b"SQLite format 3\0", "sqlite", True), "k": (b"\xd4\xc3\xb2\xa1" + bytes(20), "pcap", True),
        "l": (b"\n\r\r\n" + bytes(30), "pcapng", True), "m": (z.getvalue(), "excel", True), "n": (plain.getvalue(), "archive", True), "o": (b"7z\xbc\xaf\x27\x1c", "archive", True), "p": (b"Rar!\x1a\7\0", "archive", True), "q": (b"Rar!\x1a\7\1\0", "archive", True),
        "r": (b"BZh9", "archive", True), "s": (b"\xfd7zXZ\0", "archive", True), "t": (bytes(257) + b"ustar\0", "archive", True), "u.csv": ("", "fallback", False), "v.txt": ("BMW,1\nAudi,2\n", "csv", False), "w": ("a = 1\nb = 2\nc = 3\n", "toml", False),
        "x": ("VERSION \"\"\nBU_: A\nBO_ 1 M: 8 A\n", "dbc", False), "y.shp": ((9994).to_bytes(4, "big") + bytes(24) + (1000).to_bytes(4, "little") + (1).to_bytes(4, "little") + bytes(64), "shp", True), "z.zip": ("???", "archive", False),
    }
    for name, (content, *_) in cases.items():
        put(tmp_path, name, content)
    got = {os.path.basename(r["file"]): (r["format"], r["by_signature"]) for r in detect.detect(spark, str(tmp_path), "fallback").collect()}
    for name, (_, *want) in cases.items():
        assert got[name] == tuple(want), name
    lenient = {os.path.basename(r["file"]): r["format"] for r in detect.detect(spark, str(tmp_path / "v.txt"), compat=True).collect()}
    assert lenient["v.txt"] == "image"


DBC = """VERSION "1.0"
BU_: ECU BCM Tester
BO_ 256 EngineData: 8 ECU
 SG_ EngineSpeed : 24|16@1+ (0.125,0) [0|8000] "rpm" BCM,Tester
 SG_ Mode : 0|2@1+ (1,0) [0|3] "" BCM
CM_ BO_ 256 "Engine state";
CM_ SG_ 256 EngineSpeed "Speed of it";
VAL_ 256 Mode 0 "Off" 1 "Idle" 2 "Run" ;
VAL_ 256 Nothing 0 "x" ;
BO_ 2147483904 Ext: 4 BCM
 SG_ Temp : 7|12@0- (1,-40) [-40|215] "C" Tester
"""


def test_dbc(spark, tmp_path):
    got = catalogs.read_dbc(spark, put(tmp_path, "a.dbc", DBC))
    m = {r["message_id"]: r for r in got["messages"].collect()}
    speed = next(s for s in m[256]["signals"] if s["signal"] == "EngineSpeed")
    assert (m[256]["name"], m[256]["id_hex"], m[256]["dlc"], m[256]["comment"]) == ("EngineData", "0x100", 8, "Engine state")
    assert (speed["start"], speed["length"], speed["byte_order"], speed["signed"], speed["factor"], list(speed["receivers"]), speed["comment"]) == (24, 16, "Intel", False, 0.125, ["BCM", "Tester"], "Speed of it")
    mode = next(s for s in m[256]["signals"] if s["signal"] == "Mode")
    assert [(v["value"], v["label"]) for v in mode["values"]] == [(0, "Off"), (1, "Idle"), (2, "Run")]
    temp = m[2147483904]["signals"][0]
    assert (temp["byte_order"], temp["signed"], temp["offset"]) == ("Motorola", True, -40.0)
    assert tuple(got["stats"].first())[1:] == (2, 3, 3, 1, 8)
    assert got["warnings"].count() == 1 and [r["node"] for r in got["nodes"].collect()] == ["ECU", "BCM", "Tester"]
    assert catalogs.dbc_filter(got["messages"], "Tester", "rpm").count() == 1 and catalogs.dbc_filter(got["messages"], "Nobody").count() == 0


def test_text_catalogs(spark, tmp_path):
    arxml = '<?xml version="1.0"?><AUTOSAR xmlns="http://autosar.org/4.0"><AR-PACKAGE><SHORT-NAME>Pkg</SHORT-NAME><CAN-CLUSTER><SHORT-NAME>CAN</SHORT-NAME></CAN-CLUSTER><FRAME><SHORT-NAME>FrameA</SHORT-NAME></FRAME><FRAME-REF DEST="FRAME">/Frame/FrameA</FRAME-REF></AR-PACKAGE></AUTOSAR>'
    r = catalogs.read_arxml(spark, put(tmp_path, "a.arxml", arxml))
    assert [(x["type"], x["name"]) for x in r.tables["elements"].collect()] == [("CAN-CLUSTER", "CAN"), ("FRAME", "FrameA")]
    assert [tuple(x)[1:] for x in r.tables["references"].collect()] == [("FRAME-REF", "FRAME", "/Frame/FrameA")] and r.tables["packages"].first()["name"] == "Pkg"
    a2l = catalogs.read_a2l(spark, put(tmp_path, "a.a2l", '/begin PROJECT P "x"\n  /begin MEASUREMENT Speed\n /end MEASUREMENT\n/begin IF_DATA "XCP"\n/end PROJECT\n'))
    assert {(x["type"], x["name"], x["line"]) for x in a2l.tables["blocks"].collect()} == {("PROJECT", "P", 1), ("MEASUREMENT", "Speed", 2), ("IF_DATA", "XCP", 4)}
    asc = catalogs.read_asc(spark, put(tmp_path, "a.asc", "date Mon\nbase hex timestamps absolute\n\n30.300981 CANFD 3 Tx 50005x 0 1 5 0 140000 73 200050\n0.5 1 123 Rx d 8 01 02\n"))
    assert {tuple(x)[1:] for x in asc.tables["events"].collect()} == {("30.300981", "CANFD", "3", "Tx", "50005x", "0", "140000 73 200050", 4), ("0.5", "CAN", "1", "Rx", "123", "8", "01 02", 5)}
    step = catalogs.read_step(spark, put(tmp_path, "a.stp", "ISO-10303-21;\nHEADER;\nFILE_NAME('part','2020',('me'),('org'),'pre','sys','ok');\nFILE_SCHEMA(('AP214'));\nENDSEC;\n#1 = VERTEX_POINT('',#2);\n#2=VERTEX_POINT('',#3);\n#3=CARTESIAN_POINT('');\n"))
    head = {x["field"]: x["value"] for x in step.tables["header"].collect()}
    assert (head["name"], head["schema"], head["organization"]) == ("part", "AP214", "org")
    assert [(x["type"], x["count"]) for x in step.tables["top_types"].collect()] == [("VERTEX_POINT", 2), ("CARTESIAN_POINT", 1)]
    reqif = '<REQ-IF><REQ-IF-HEADER IDENTIFIER="h1"><TITLE>T &amp; U</TITLE></REQ-IF-HEADER><SPEC-OBJECT IDENTIFIER="o1" LONG-NAME="O"><SPEC-OBJECT-TYPE-REF/></SPEC-OBJECT><SPECIFICATION IDENTIFIER="s1"/><SPEC-RELATION IDENTIFIER="r1"/></REQ-IF>'
    q = catalogs.read_reqif(spark, put(tmp_path, "a.reqif", reqif))
    assert [q.tables[k].count() for k in ("objects", "specifications", "relations")] == [1, 1, 1]
    assert {x["field"]: x["value"] for x in q.tables["header"].collect()}["title"] == "T & U"
    assert json.loads(q.to_json())["tables"]["specifications"]["rows"][0][-1] == "-"


def dns_frame():
    query = struct.pack(">6H", 0x1234, 0x0100, 1, 0, 0, 0) + b"\7example\3com\0" + struct.pack(">2H", 1, 1)
    udp = struct.pack(">4H", 53000, 53, 8 + len(query), 0) + query
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(udp), 0, 0, 64, 17, 0, bytes([192, 168, 0, 2]), bytes([8, 8, 8, 8]))
    return bytes(12) + b"\x08\x00" + ip + udp


def test_captures(spark, tmp_path):
    frame = dns_frame()
    pcap = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + struct.pack("<4I", 10, 123, len(frame), len(frame)) + frame
    r = packets.read_pcap(spark, put(tmp_path, "a.pcap", pcap))
    p = r.tables["packets"].first()
    assert (p["no"], p["timestamp"], p["protocol"], p["source"], p["destination"], p["offset"]) == (1, "10.000123", "DNS", "192.168.0.2:53000", "8.8.8.8:53", "0x18")
    assert p["info"] == "Query id=0x1234, rcode=NOERROR, questions=1, answers=0, example.com A" and r.warnings.count() == 0
    cut = packets.read_pcap(spark, put(tmp_path, "c.pcap", pcap + bytes(16 + 3)[:17] + b"\xff"))
    assert cut.tables["packets"].count() >= 1 and cut.warnings.count() == 1
    ng = struct.pack("<IIIHHqI", 0x0A0D0D0A, 28, 0x1A2B3C4D, 1, 0, -1, 28) + struct.pack("<IIHHII", 1, 20, 1, 0, 65535, 20) + struct.pack("<8I", 6, 32, 0, 0, 5, 0, 0, 32)
    block = struct.pack("<7I", 6, 36, 0, 1, 5, 4, 4) + b"\1\2\3\4" + struct.pack("<I", 36)
    n = packets.read_pcapng(spark, put(tmp_path, "a.pcapng", ng[:48] + block))
    row = n.tables["blocks"].orderBy("no").collect()[-1]
    assert (row["no"], row["type"], row["length"], row["captured"], row["original"], row["offset"]) == (3, "Enhanced Packet", 36, 4, 4, "0x30")
    assert n.tables["packets"].first()["timestamp"] == str((1 << 32) + 5) and n.tables["packets"].first()["protocol"] == "Ethernet"


def test_dissection():
    from millrace.functions.net import dissect, ipv6_text

    arp = bytes(6) + bytes.fromhex("aabbcc001122") + b"\x81\x00\x00\x05\x08\x06" + struct.pack(">HHBBH", 1, 0x0800, 6, 4, 1) + bytes.fromhex("aabbcc001122") + bytes([10, 0, 0, 1]) + bytes(6) + bytes([10, 0, 0, 2])
    assert dissect(arp, 1).info == "Who has 10.0.0.2? Tell 10.0.0.1 VLAN 5"
    assert ipv6_text(bytes(15) + b"\1") == "0:0:0:0:0:0:0:1"
    tcp = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 40 + 37, 0, 0, 64, 6, 0, b"\1\1\1\1", b"\2\2\2\2") + struct.pack(">HHIIBBHHH", 5000, 80, 1, 2, 0x50, 0x18, 9, 0, 0) + b"GET / HTTP/1.1\r\nHost: example.com\r\n\r\n"
    assert dissect(tcp, 101).info == "GET / HTTP/1.1, Host=example.com" and dissect(b"", 1).info == "Empty packet"
    # an answer's name by pointer: what follows is read from the right place
    q = struct.pack(">6H", 1, 0x8180, 1, 1, 0, 0) + b"\1a\2bc\0" + struct.pack(">2H", 1, 1) + b"\xc0\x0c" + struct.pack(">HHIH", 1, 1, 60, 4) + b"\5\6\7\x08"
    udp = struct.pack(">4H", 53, 999, 8 + len(q), 0) + q
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(udp), 0, 0, 64, 17, 0, b"\1\1\1\1", b"\2\2\2\2") + udp
    assert dissect(ip, 228).info.endswith("a.bc A, a.bc A 5.6.7.8")


def test_trees(spark, tmp_path):
    t = trees.read_toml(spark, put(tmp_path, "a.toml", '# note\na=1\na=2\n[[x]]\nn = "q # r"\n[[x]]\nd = 2020-01-02\n[t.u]\nv = {p = 1.5, q = [true, 2]}\n'))
    assert [r["message"] for r in t["warnings"].collect()] == ["Duplicate key: a"]
    flat = {r["path"]: (r["value_type"], r["value"]) for r in t["flattened"].collect()}
    assert flat == {"a": ("integer", "2"), "x[0].n": ("string", "q # r"), "x[1].d": ("datetime", "2020-01-02"), "t.u.v.p": ("float", "1.5"), "t.u.v.q[0]": ("boolean", "true"), "t.u.v.q[1]": ("integer", "2")}
    y = trees.read_yaml(spark, put(tmp_path, "a.yaml", 'k-1: {"odd key": yes}\nbase: &b {x: 1}\nuse:\n  <<: *b\n  x: 2\nz: *none\n---\njobs: {steps: [1]}\n'))
    nodes = {(r["document"], r["path"]): r for r in y["nodes"].collect()}
    odd = nodes[0, 'k-1["odd key"]']
    assert odd["json_path"] == '$["k-1"]["odd key"]' and odd["ambiguous"]
    assert nodes[0, "use.x"]["overrides"] and nodes[0, 'use["<<"]']["alias_path"] == "base" and list(nodes[1, "jobs.steps"]["tags"]) == ["step flow"]
    assert [r["message"] for r in y["diagnostics"].collect()] == ['Invalid anchor reference "*none"'] or y["diagnostics"].count() == 1
    assert trees.search_nodes(y["nodes"], "odd key", "key").count() == 1


PROTO = """syntax = "proto3";
package acme.orders;
import "google/protobuf/empty.proto";
// An order.
message Order {
  string id = 1;
  repeated Line lines = 2;
  Status status = 3;
  message Line { string sku = 1; int32 quantity = 2; }
}
enum Status { UNKNOWN = 0; OPEN = 1; }
service Orders {
  rpc Get (Order) returns (Order);
  rpc Watch (Order) returns (stream Order) {}
}
message Broken { int32 first = 1; int32 second = 1; Missing m = 2; }
"""


def test_proto(spark, tmp_path):
    p = trees.read_proto(spark, put(tmp_path, "a.proto", PROTO))
    assert {r["full_name"] for r in p["messages"].collect()} == {"acme.orders.Order", "acme.orders.Order.Line", "acme.orders.Broken"}
    assert tuple(p["stats"].first())[1:] == (3, 1, 1, 2, 8, 1)
    messages = {r["message"] for r in p["warnings"].collect()}
    assert messages == {"acme.orders.Broken reuses field number 1 for first and second.", "acme.orders.Broken.m references Missing on line 16, but it is not declared in this file."}
    refs = {(r["full_name"], r["from"]) for r in trees.references_to(p["edges"], p["messages"]).collect()}
    assert ("acme.orders.Order.Line", "acme.orders.Order.lines") in refs
    fields = [r.asDict() for r in p["fields"].collect()]
    assert trees.proto_example(fields, {"acme.orders.Status": "UNKNOWN"}, "acme.orders.Order") == {"id": "", "lines": [{"sku": "", "quantity": 0}], "status": "UNKNOWN"}


def test_proto_comments_and_texts(spark, tmp_path):
    text = """syntax = 'proto3';
import 'x.proto';
/* A message
 * of two lines */ message M { // not a doc
  /* id */ string a = 1;
  /* ends
   here */ string b = 2;
  string c = 3 [(u) = "http://x;y"]; // c
  string d = 4;
  string e = 5 [(o) = { k: "]" }, deprecated = true];
  option (z) = { k: 1 };
  int32 f = 6;
}
message N { string g = 1; }
"""
    p = trees.read_proto(spark, put(tmp_path, "b.proto", text))
    fields = {(r["message"], r["name"]): (r["number"], r["doc"], r["line"]) for r in p["fields"].collect()}
    assert fields == {("M", "a"): (1, "id", 5), ("M", "b"): (2, "ends\nhere", 7), ("M", "c"): (3, None, 8), ("M", "d"): (4, None, 9), ("M", "e"): (5, None, 10), ("M", "f"): (6, None, 12), ("N", "g"): (1, None, 14)}
    assert [r["path"] for r in p["imports"].collect()] == ["x.proto"] and p["messages"].filter("name = 'M'").first()["doc"] == "A message\nof two lines"
    assert p["warnings"].count() == 0


def test_dbc_comments_on_nodes_and_file(spark, tmp_path):
    d = catalogs.read_dbc(spark, put(tmp_path, "c.dbc", 'BU_: A B\nBO_ 1 M: 8 A\n SG_ S : 0|8@1+ (1,0) [0|1] "" B\nCM_ BU_ A "a node";\nCM_ "the file";\nCM_ BO_ 1 "a message";\nCM_ SG_ 1 S "a signal";\n'))
    assert {(r["target"], r["message_id"], r["signal"], r["node"], r["comment"]) for r in d["comments"].collect()} == {("node", None, None, "A", "a node"), ("network", None, None, None, "the file"), ("message", 1, None, None, "a message"), ("signal", 1, "S", None, "a signal")}
    assert d["messages"].first()["comment"] == "a message"


@pytest.mark.parametrize("word", ["C4Context", "sankey-beta", "kanban", "treemap-beta", "venn"])
def test_newer_diagrams(word):
    from millrace.sources.detect import sniff_text

    assert sniff_text(f"%% note\n{word}\n  x\n", ".zzz") == "mermaid"


def test_toml_rules(spark, tmp_path):
    text = """top = 'it''s' # c
# about
# the server
[server]
host."a.b" = "x # y"
ports = [ 1, [2, 3], , ] # z

# lost

empty =
broken = [1, 2
mixed = [1] x
when = 1979-05-27T07:32:00Z
# first
[[a.b]]
n = 1_000
[[a.b]]
n = -2.5e3
c = { d = true, e = [], "f g" = 'h' }
[a]
late = +1.
no assignment
= 3
[server]
host."a.b" = 5
"""
    t = trees.read_toml(spark, put(tmp_path, "r.toml", text))
    flat = [(r["path"], r["value_type"], r["value"]) for r in t["flattened"].orderBy("id").collect()]
    assert flat == [
        ("top", "string", "it''s"), ("server.host.a.b", "integer", "5"), ("server.ports[0]", "integer", "1"), ("server.ports[1][0]", "integer", "2"), ("server.ports[1][1]", "integer", "3"), ("server.empty", "string", ""), ("server.broken", "string", "[1, 2"),
        ("server.mixed", "string", "[1] x"), ("server.when", "datetime", "1979-05-27T07:32:00Z"), ("a.b[0].n", "integer", "1000"), ("a.b[1].n", "float", "-2500.0"), ("a.b[1].c.d", "boolean", "true"), ("a.b[1].c.f g", "string", "h"), ("a.late", "float", "1.0"),
    ]
    assert {(r["message"], r["line"]) for r in t["warnings"].collect()} == {("Expected key/value assignment.", 22), ("Missing key before assignment.", 23), ("Duplicate key: server.host.a.b", 25)}
    notes = {r["path"]: r["comment"] for r in t["nodes"].filter("comment is not null").collect()}
    assert notes == {"server": "about\nthe server", "a.b": "first", "a.b[0]": "first"}


def test_containers(spark, tmp_path):
    db = tmp_path / "a.db3"
    with sqlite3.connect(db) as c:
        c.execute("CREATE TABLE messages (topic TEXT, value INTEGER, payload BLOB)")
        c.execute("INSERT INTO messages VALUES ('gps', 42, x'010203'), (NULL, NULL, NULL)")
    rows = containers.read_sqlite_rows(spark, str(db)).orderBy("rowid").collect()
    assert [tuple(c) for c in rows[0]["cells"]] == [("topic", "gps", "text"), ("value", "42", "integer"), ("payload", "BLOB(3 bytes) 010203", "blob")]
    t = containers.read_sqlite_table(spark, str(db), "messages")
    assert t.schema["value"].dataType.simpleString() == "bigint" and t.orderBy("rowid").collect()[1]["topic"] is None
    assert containers.user_tables(containers.read_sqlite_schema(spark, str(db))).count() == 1
    blf = b"LOGG" + struct.pack("<I", 144) + bytes(24) + struct.pack("<I", 2) + bytes(92) + struct.pack("<Q", 3) + bytes(20)
    assert tuple(containers.read_blf(spark, put(tmp_path, "a.blf", blf)).first())[1:] == ("LOGG", 144, 2, 3, True)
    heads, blocks = containers.read_mf4(spark, put(tmp_path, "a.mf4", "MDF     4.10    TEST    ##HD##DG##CG##CN"))
    assert tuple(heads.first())[1:] == ("MDF", "4.10", "TEST") and {r["count"] for r in blocks.collect()} == {1} and blocks.count() == 4
    avro = b"Obj\1" + b"\4" + b"\x16avro.schema" + b'\x14{"a":  1 }' + b"\x14avro.codec" + b"\x08null" + b"\0" + bytes(16)
    assert {(r["key"], r["value"]) for r in containers.read_avro_header(spark, put(tmp_path, "a.avro", avro)).collect()} == {("avro.schema", '{"a":1}'), ("avro.codec", "null")}
    _, records = containers.read_bag(spark, put(tmp_path, "a.bag", b"#ROSBAG V2.0\nop=\x07 op=\x05"))
    assert {(r["record"], r["count"]) for r in records.collect()} == {("Connection", 1), ("Chunk", 1)}
    head = json.dumps({"w": {"dtype": "F32", "shape": [2, 3], "data_offsets": [0, 24]}, "__metadata__": {}}).encode()
    assert tuple(containers.read_safetensors(spark, put(tmp_path, "a.safetensors", struct.pack("<Q", len(head)) + head + bytes(24))).first())[1:] == ("w", "F32", [2, 3], 24, 0)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("b.txt", "hello")
        z.writestr("a/", "")
    entries = containers.read_archive(spark, str(tmp_path / "a.zip")).collect()
    assert [(r["path"], r["kind"], r["size"]) for r in entries] == [("a/", "directory", 0), ("b.txt", "file", 5)]
    assert containers.read_entry(spark, str(tmp_path / "a.zip"), "b.txt").first()["text"] == "hello"
    with tarfile.open(tmp_path / "a.tgz", "w:gz") as t:
        t.addfile(tarfile.TarInfo("x"), io.BytesIO())
    assert containers.read_archive(spark, str(tmp_path / "a.tgz")).first()["path"] == "x"
    put(tmp_path, "n.txt.gz", gzip.compress(b"abc"))
    assert tuple(containers.read_archive(spark, str(tmp_path / "n.txt.gz")).first())[1:3] == ("n.txt", "file")
    assert containers.looks_binary(b"a\0") and not containers.looks_binary(b"text\n")


def element(kind, raw):
    return struct.pack("<2I", kind, len(raw)) + raw + bytes(-len(raw) % 8)


def test_arrays(spark, tmp_path):
    body = element(6, struct.pack("<2I", 6, 0)) + element(5, struct.pack("<2i", 1, 3)) + element(1, b"answer") + element(9, struct.pack("<3d", 1.5, 2.5, 3.5))
    text = element(6, struct.pack("<2I", 4, 0)) + element(5, struct.pack("<2i", 1, 5)) + element(1, b"label") + element(4, np.array([ord(c) for c in "hello"], "<u2").tobytes())
    head = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM"
    import zlib

    packed = zlib.compress(element(14, text))
    mat = put(tmp_path, "a.mat", head + element(14, body) + struct.pack("<2I", 15, len(packed)) + packed)
    got = {r["name"]: (r["class"], r["size"], r["preview"]) for r in arrays.read_mat(spark, mat).collect()}
    assert got == {"answer": ("double", "1 x 3", "1.5, 2.5, 3.5"), "label": ("char", "1 x 5", '"hello"')}
    v4 = struct.pack("<5i", 0, 2, 2, 0, 7) + b"legacy\0" + struct.pack("<4d", 10, 20, 30, 40)
    assert tuple(arrays.read_mat(spark, put(tmp_path, "b.mat", v4)).first())[1:] == ("legacy", "numeric", "2 x 2", "MOPT 0", 32, None, "10, 20, 30, 40")
    # a small file of the latest layout: root group with one dataset by a hard link
    dataset = b"OHDR\2\0" + bytes([38]) + bytes([1]) + struct.pack("<HB", 12, 0) + bytes([2, 1, 0, 1]) + struct.pack("<Q", 5) + bytes([3]) + struct.pack("<HB", 12, 0) + bytes([0x10, 8, 0, 0]) + struct.pack("<I", 4) + bytes(4)
    root_at, data_at = 48, 200
    link = bytes([1, 0]) + bytes([3]) + b"ids" + struct.pack("<Q", data_at)
    root = b"OHDR\2\0" + bytes([4 + len(link)]) + bytes([6]) + struct.pack("<HB", len(link), 0) + link + bytes(4)
    h5 = (arrays.HDF5_MAGIC + bytes([3, 8, 8, 0]) + struct.pack("<4Q", 0, (1 << 64) - 1, 400, root_at) + bytes(4) + root).ljust(data_at, b"\0") + dataset + bytes(60)
    entries = {r["path"]: (r["kind"], list(r["shape"]), r["dtype"], r["element_bytes"]) for r in arrays.read_hdf5(spark, put(tmp_path, "a.h5", h5)).collect()}
    assert entries == {"/": ("group", [], None, None), "/ids": ("dataset", [5], "Integer32", 4)}


def test_shapefile(spark, tmp_path):
    point = lambda n, x, y: struct.pack(">2i", n, 10) + struct.pack("<i2d", 1, x, y)
    head = (9994).to_bytes(4, "big") + bytes(24) + struct.pack("<2i", 1000, 1) + bytes(64)
    put(tmp_path, "a.shp", head + point(1, 1.0, 2.0) + point(2, 3.0, -4.0))
    put(tmp_path, "a.dbf", struct.pack("<BBBBIHH", 3, 0, 0, 0, 2, 65, 6) + bytes(20) + b"name".ljust(11, b"\0") + b"C" + bytes(4) + bytes([5]) + bytes(15) + b"\r" + b" one  " + b" two  ")
    got = geo.read_shapefile(spark, str(tmp_path / "a.shp"), limit=1).collect()
    assert len(got) == 1 and got[0]["properties"] == {"name": "one"} and got[0]["geom_type"] == "Point" and got[0]["has_dbf"] and not got[0]["has_prj"]
    boxes, kinds, names = geo.summarize_features(geo.read_shapefile(spark, str(tmp_path / "a.shp")))
    assert tuple(boxes.first())[1:] == (2, 2, 1.0, -4.0, 3.0, 2.0) and kinds.first()["n"] == 2 and names.first()["property"] == "name"


def test_sound(spark, tmp_path):
    pcm = put(tmp_path, "a.pcm", bytes(32000))
    assert media.read_audio_info(spark, pcm).first()["duration"] == 1.0
    x = np.sin(np.arange(6000) / 10)
    wav = put(tmp_path, "a.wav", media.wav_bytes(np.stack([x, x], 1), 8000))
    info = media.read_audio_info(spark, wav).first()
    assert (info["format"], info["sample_rate"], info["channels"], info["bit_depth"], info["frames"]) == ("wav", 8000, 2, 16, 6000)
    samples = media.read_audio(spark, wav)
    peaks = [r["peak"] for r in media.peaks(samples, 3).orderBy("bucket").collect()]
    assert len(peaks) == 3 and all(abs(p - 1) < 1e-3 for p in peaks)
    spectrum = media.read_spectrogram(spark, wav).orderBy("column").collect()
    assert len(spectrum) == (6000 - 2048) // 512 + 1 and len(spectrum[0]["bands"]) == media.BANDS
    back = media.to_wav(samples, 8000).first()["content"]
    assert np.allclose(media.decode(bytes(back))[3], media.decode(open(wav, "rb").read())[3], atol=2e-4)


def test_large_blobs_entries_and_sounds_are_whole(spark, tmp_path):
    blob, text = bytes(range(256)) * 5, "line of text\n" * 100_000
    db = tmp_path / "b.db3"
    with sqlite3.connect(db) as c:
        c.execute("CREATE TABLE t (b BLOB)")
        c.execute("INSERT INTO t VALUES (?)", (blob,))
    assert containers.read_sqlite_table(spark, str(db), "t").first()["b"] == f"BLOB(1280 bytes) {blob.hex()}"
    assert containers.read_sqlite_rows(spark, str(db), preview=True).first()["cells"][0]["value"] == f"BLOB(1280 bytes) {blob[:24].hex()}..."
    with zipfile.ZipFile(tmp_path / "b.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("long.txt", text)
        z.writestr("short.txt", text[:100_000])
    with tarfile.open(tmp_path / "b.tar", "w") as t:
        info = tarfile.TarInfo("long.txt")
        info.size = len(text)
        t.addfile(info, io.BytesIO(text.encode()))
    read = lambda name, entry, **o: containers.read_entry(spark, str(tmp_path / name), entry, **o).first()["text"]
    assert read("b.zip", "long.txt") == text == read("b.tar", "long.txt") and read("b.zip", "short.txt") == text[:100_000]
    assert read("b.zip", "long.txt", preview=True) is None and len(read("b.zip", "short.txt", preview=True)) == 64 << 10
    number = lambda n: bytes([2 * n & 127 | 128, n >> 6 & 127 | 128, n >> 13])
    item = lambda raw: number(len(raw)) + raw
    avro = b"Obj\1" + number(1) + item(b"big") + item(b"x" * 70_000) + number(100) + b"".join(item(b"k%d" % i) + item(b"v") for i in range(100)) + b"\0"
    assert len(list(containers._avro_metadata(avro))) == 101 and len(list(containers._avro_metadata(avro, preview=True))) == 1
    x = np.zeros(media.COLUMNS * 4096, np.float32)
    x[2600:2900] = np.sin(np.arange(300))
    assert media.spectrogram(x, media.RAW_RATE).any() and not media.spectrogram(x, media.RAW_RATE, preview=True).any()


def test_workbook_and_charts(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><r><t>Al</t></r><r><t>ice</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>2.0</v></c><c r="C2" s="1"><v>44203</v></c></row></sheetData></worksheet>')
    rows = office.read_sheet(spark, str(tmp_path / "a.xlsx")).collect()
    assert [tuple(r) for r in rows] == [(0, "Alice", "2", "2021-01-07T00:00:00.000Z")]
    a, c = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/drawingml/2006/chart"
    with zipfile.ZipFile(tmp_path / "a.pptx", "w") as z:
        z.writestr("ppt/slides/slide1.xml", f'<s xmlns:a="{a}"><a:tbl><a:tr><a:tc><a:t>x</a:t><a:t>y</a:t></a:tc><a:tc/></a:tr></a:tbl></s>')
        z.writestr("ppt/charts/chart1.xml", f'<c:c xmlns:c="{c}"><c:lineChart><c:ser><c:cat><c:pt idx="0"><c:v>q1</c:v></c:pt><c:pt idx="1"><c:v>q2</c:v></c:pt></c:cat><c:val><c:pt idx="1"><c:v>5</c:v></c:pt></c:val></c:ser></c:lineChart></c:c>')
    assert list(office.read_slide_tables(spark, str(tmp_path / "a.pptx")).first()["cells"]) == ["x y", ""]
    assert [(r["category"], r["value"]) for r in office.read_charts(spark, str(tmp_path / "a.pptx")).orderBy("idx").collect()] == [("q1", 0.0), ("q2", 5.0)]


def test_android_xml():
    from millrace.sources.android import decode_binary_xml, typed_value

    names = ["manifest", "package", "a.b"]
    pool = b"".join(struct.pack("<H", len(s)) + s.encode("utf-16-le") + b"\0\0" for s in names)
    offsets, at = [], 0
    for s in names:
        offsets.append(at)
        at += 4 + 2 * len(s)
    size = 28 + 12 + len(pool)
    strings = struct.pack("<HHI5I", 1, 28, size, 3, 0, 0, 40, 0) + struct.pack("<3I", *offsets) + pool
    start = struct.pack("<HHIIi2iHHHHHH", 0x102, 16, 56, 1, -1, -1, 0, 20, 20, 1, 0, 0, 0) + struct.pack("<3iHBBI", -1, 1, 2, 8, 0, 3, 2)
    end = struct.pack("<HHIIi2i", 0x103, 16, 24, 1, -1, -1, 0)
    body = strings + start + end
    assert "<manifest package=\"a.b\">" in decode_binary_xml(struct.pack("<HHI", 3, 8, 8 + len(body)) + body)
    assert (typed_value(0x12, 1, []), typed_value(0x11, 255, []), typed_value(0x05, 0x1001, []), typed_value(0x1C, 0xFF00FF00, [])) == ("true", "0xff", "16dp", "#ff00ff00")


def test_streams(spark, tmp_path):
    from millrace.streaming import streams

    src = str(tmp_path / "src")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3).write.parquet(src)
    stream = streams.parquet_stream(spark, src, spark.read.parquet(src).schema)
    got = streams.run_once(streams.windowed_counts(stream, "ts", "event_type", "1 day"), "w", str(tmp_path / "c"), "complete")
    assert got.agg(F.sum("n")).first()[0] == spark.read.parquet(src).count()
