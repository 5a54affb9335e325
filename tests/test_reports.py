"""Glossary maintenance, CSV reports and graph lines."""

import csv
import io
import json

from pyspark.sql import functions as F

from quarry.functions.text import type_parts
from quarry.operators import glossary
from quarry.sources import reports

SCHEMA = "id string, target string, target_kind string, terms array<string>, note string, author string, updated_at string"


def test_glossary(spark):
    old = spark.createDataFrame([("1", "Stock", "object", ["goods"], "n", "a", "t1"), ("2", "Price", "object", ["cost"], "", "a", "t1")], SCHEMA)
    new = spark.createDataFrame([("stock", "object", ["Goods", " store ", ""], "", "b", "t3"), ("stock", "object", ["x"], "z", "b", "t2"), ("Tax", "object", ["vat"], "m", "b", "t2")], SCHEMA.replace("id string, ", "", 1))
    out = {r.target: tuple(r) for r in glossary.save(old, new).collect()}
    assert out["stock"] == ("1", "stock", "object", ["goods", "store"], "n", "b", "t3")
    assert out["Price"] == ("2", "Price", "object", ["cost"], "", "a", "t1")
    assert out["Tax"][2:] == ("object", ["vat"], "m", "b", "t2") and len(out["Tax"][0]) == 8
    replaced = {r.target: tuple(r) for r in glossary.save(old, new, merge=False).collect()}
    assert replaced["stock"][3:5] == (["Goods", "store"], "")
    assert [r.id for r in glossary.remove(old, ["1"]).collect()] == ["2"] and glossary.remove(old, []).count() == 2
    assert glossary.save(old.limit(0), new.limit(0)).count() == 0


def test_csv(spark, tmp_path):
    rows = [("a;b", 1), ('say "x"', 2), ("two\nlines", None), (None, 4)]
    reports.write_csv(spark.createDataFrame(rows, "name string, `n.n` int").coalesce(1), str(tmp_path / "out"))
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    assert raw.startswith(b"\xef\xbb\xbfname;n.n\r\n")
    found = list(csv.reader(io.StringIO(raw.decode("utf-8-sig"), newline=""), delimiter=";"))
    assert found[1:] == [["a;b", "1"], ['say "x"', "2"], ["two\nlines", ""], ["", "4"]]


def test_graph_json(spark):
    nodes = spark.createDataFrame([("a", 1)], "key string, depth int")
    edges = spark.createDataFrame([("a", "b")], "source string, target string")
    assert [json.loads(r.json) for r in reports.graph_json(nodes, edges).collect()] == [{"part": "node", "key": "a", "depth": 1}, {"part": "edge", "source": "a", "target": "b"}]


def test_type_parts(spark):
    row = spark.range(1).select(type_parts(F.lit("String(10, 0), Ref.Item ,1 Number (5,2)")).alias("p")).first()
    assert row.p == ["String(10, 0)", "Ref.Item", "1 Number (5,2)"]
