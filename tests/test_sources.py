"""Readers and writers over small files."""

import pytest

from pipelens.sources import graph, reports, sinks

REPORT = """Timestamp;2026-01-01
RDF file;a.ttl
Class;Hyd

Focus node;Source;Value;Severity;Message;Path;Detail-message;Detail-value
n1 ;LengteLeiding_val; 3;Violation;m;p;d;Focus-node: type=Leiding, label=L 1, hasAspect=x
n2;CfkTypes_typ;;Warning;m;p;d;

"""


def test_report(spark, tmp_path):
    (tmp_path / "r.csv").write_text(REPORT)
    rows, preamble = reports.read(spark, str(tmp_path / "r.csv"))
    got = sorted((r["focus_node"], r["source"], r["severity"], r["cfk"], r["object_type"], r["label"]) for r in rows.collect())
    assert got == [("n1", "LengteLeiding_val", "Violation", "Hyd", "Leiding", "L 1"), ("n2", "CfkTypes_typ", "Warning", "Hyd", None, None)]
    assert reports.check_set(preamble, ["Hyd"]) == []
    assert reports.check_set(preamble, ["Hyd", "MdsPlan"]) == ["class MdsPlan is absent"]


TRIPLES = r"""<http://x/put#1> <http://x/ns#hasAspect> <http://x/a1> .
<http://x/a1> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://x/ns#Hoogte> .
<http://x/a1> <http://x/ns#hasValue> "1.5"^^<http://www.w3.org/2001/XMLSchema#decimal> .
<http://x/put#1> <http://x/ns#hasPart> _:b1 .
_:b1 <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://x/ns#Deksel> .
_:b1 <http://x/ns#hasConnection> <http://x/o> .
<http://x/l> <http://www.w3.org/2000/01/rdf-schema#label> "a \"b\"\n" .
# a comment
not a statement
"""


def test_triples(spark, tmp_path):
    (tmp_path / "t.nt").write_text(TRIPLES)
    t = graph.triples(spark, str(tmp_path / "t.nt"))
    assert t.count() == 7
    assert [(r["object_id"], r["kind"], r["value"]) for r in graph.aspects(t).collect()] == [("http://x/put#1", "Hoogte", "1.5")]
    assert [(r["child_id"], r["child_types"]) for r in graph.parts(t).collect()] == [("_:b1", ["Deksel"])]
    assert {(r["a"], r["b"]) for r in graph.connections(t).collect()} == {("_:b1", "http://x/o"), ("http://x/o", "_:b1")}
    assert t.where("o_kind = 'literal' and datatype is null").first()["o"] == 'a "b"\n'
    audit = graph.encoding_audit(spark, str(tmp_path / "t.nt")).first()
    assert audit["valid"] and audit["not_ascii"] == 0


def test_gml_and_dates(spark):
    rows = [
        ('<gml:Point><gml:pos>1 2</gml:pos></gml:Point>',),
        ('<gml:LineString srsDimension="3"><gml:posList>0 0 1 4 0 2</gml:posList></gml:LineString>',),
        ('<gml:MultiCurve><gml:LineString><gml:posList>0 0 1 1</gml:posList></gml:LineString><gml:LineString><gml:posList>2 2 3 3</gml:posList></gml:LineString></gml:MultiCurve>',),
        ('<gml:Point><gml:pos>1 x</gml:pos></gml:Point>',),
        ("nothing",),
    ]
    got = [r["g"] for r in spark.createDataFrame(rows, "v string").select(graph.gml(__import__("pyspark").sql.functions.col("v")).alias("g")).collect()]
    assert (got[0]["kind"], got[0]["pts"][0]["x"], got[0]["error"]) == ("Point", 1.0, None)
    assert got[1]["zs"] == [1.0, 2.0] and len(got[1]["pts"]) == 2
    assert got[2]["multipart"] and not got[0]["multipart"]
    assert got[3]["error"] and got[4]["error"] == "no known geometry"
    days = spark.createDataFrame([("2020-02-03T00:00",), ("1999",), ("0000",), ("2020-13-01",), ("x",), (None,)], "v string")
    assert [str(r["d"]) for r in days.select(graph.date_of(days["v"]).alias("d")).collect()] == ["2020-02-03", "1999-01-01", "None", "None", "None", "None"]


def test_sinks_guard_their_inputs(spark, tmp_path):
    found = spark.createDataFrame([("a", "TOP")], "finding_id string, category string")
    sinks.archive(found, str(tmp_path / "out"), [str(tmp_path / "in")])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    with pytest.raises(ValueError):
        sinks.archive(found, str(tmp_path / "in" / "sub"), [str(tmp_path / "in")])


def test_escapes_are_decoded_once(spark, tmp_path):
    lines = [
        r'<a> <p> "C:\\new" .', r'<b> <p> "caf\u00e9 \U0001F600 \uD83D\uDE00" .', r'<c> <p> "tab\there\r\n\b\f\"\'" .', r'<d> <p> "\\u00e9"@nl . # said', r'<e\u00e9> <p> <x\u0020y> .',
        "broken <x> .", "broken <x> .", "  # only a comment", "", "<a> <b> .",
    ]
    (tmp_path / "e.nt").write_text("\n".join(lines))
    got = {r["s"]: r["o"] for r in graph.triples(spark, str(tmp_path / "e.nt")).collect()}
    assert got == {"a": r"C:\new", "b": "café \U0001f600 \U0001f600", "c": "tab\there\r\n\b\f\"'", "d": r"\u00e9", "eé": "x y"}
    assert sorted((r["line"], r["n"]) for r in graph.unread(spark, str(tmp_path / "e.nt")).collect()) == [("<a> <b> .", 1), ("broken <x> .", 2)]


def test_encoding_audit_samples(spark, tmp_path):
    old = ["plain", *[f"ligt é {k}" for k in range(7)], "ligt é 0"]
    (tmp_path / "old.nt").write_bytes("\n".join(old).encode("latin-1"))
    (tmp_path / "new.nt").write_text("één\nstraße", encoding="utf-8")
    got = {r["path"].rsplit("/", 1)[1]: r for r in graph.encoding_audit(spark, str(tmp_path)).collect()}
    assert not got["old.nt"]["valid"] and got["old.nt"]["not_ascii"] == 8 and got["old.nt"]["samples"] == [f"ligt é {k}" for k in range(5)]
    assert got["new.nt"]["valid"] and got["new.nt"]["not_ascii"] == 6 and got["new.nt"]["samples"] == [] and got["new.nt"]["length"] == len("één\nstraße".encode())
    (tmp_path / "t.nt").write_bytes('<a> <p> "é" .'.encode("latin-1"))
    assert graph.triples(spark, str(tmp_path / "t.nt"), encoding="ISO-8859-1").first()["o"] == "é"


def test_a_report_is_read_in_ranges(spark, tmp_path):
    body = "".join(f"n{k};S;{k};Violation;m;p;d;Focus-node: type=T{k % 3}, label=L, hasAspect=x\n" for k in range(4000))
    (tmp_path / "r.csv").write_text("Class;Hyd\nnote;Focus node;no header\n\n" + REPORT.split("\n")[4] + "\n" + body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1000")
        rows, preamble = reports.read(spark, str(tmp_path / "r.csv"))
        assert reports.lines(spark, str(tmp_path / "r.csv")).rdd.getNumPartitions() > 5
        assert rows.count() == 4000 and {r["cfk"] for r in rows.select("cfk").distinct().collect()} == {"Hyd"}
        assert {(r["key"], r["value"]) for r in preamble.collect()} == {("Class", "Hyd"), ("note", "Focus node")}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
