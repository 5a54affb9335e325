"""Module sources, their outline and calls, text diffs, and change streams."""

import difflib

from pyspark.sql import functions as F

from quarry.functions.source_code import calls, outline
from quarry.operators import diff
from quarry.sources.modules import line_range, module_files
from quarry.streaming import changes

TEXT = """#Region Public
// Runs all jobs.
// Returns the number.
&AtServer
Function RunJobs(Val A, B = ")",
    C) Export
    X = Module.Count(A, "Not(a) call()"); // nor This()
    Y = New Structure("k", Local(X));
    If (X > 1) Then Catalogs.Items.Find(X); EndIf;
    T = "one
    |Two(
    // Three(
    |end";
    Return X;
EndFunction
#Region Inner
#Delete
Procedure Gone()
EndProcedure
#EndDelete
&Around("Old")
Async Procedure Local()
EndProcedure
#EndRegion
#EndRegion
Процедура Последняя()
    RunJobs(1)"""


def test_outline():
    first, second, third = outline(TEXT)
    assert first[:7] == ("RunJobs", "function", True, False, 'Val A, B = ")", C', "&AtServer", "") and first[7:] == (5, 15, "Public", "Runs all jobs. Returns the number.")
    assert (second.name, second.is_async, second.intercepts, second.start_line, second.end_line, second.region) == ("Local", True, "Old", 22, 23, "Public/Inner")
    assert (third.name, third.kind, third.start_line, third.end_line, third.region, third.is_export) == ("Последняя", "procedure", 26, 27, "", False)
    assert outline("") == [] and outline("no module") == []


def test_calls():
    assert [tuple(c) for c in calls(TEXT)] == [("RunJobs", 7, "Module", "Count"), ("RunJobs", 8, "", "Local"), ("RunJobs", 9, "Catalogs.Items", "Find"), ("Последняя", 27, "", "RunJobs")]


def test_module_files(spark, tmp_path):
    def put(path, raw):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(raw)

    put("Catalogs/#U0422#U0435st/Ext/ObjectModule.bsl", "﻿a\r\nb\nc".encode())
    put("Documents/Order/Forms/Main/Ext/Form/Module.bsl", "ж".encode("cp1251"))
    put("Ext/SessionModule.bsl", b"//")
    put("Ext/ManagedApplicationModule.bsl", b"")
    put("Catalogs/Items.xml", b"<x/>")
    rows = {r.relative_path.split("/")[0]: r for r in module_files(spark, str(tmp_path)).collect()}
    a, b, c = rows["Catalogs"], rows["Documents"], rows["Ext"]
    assert (a.object_kind, a.object_name, a.form_name, a.module_type, a.text) == ("Справочник", "Теst", None, "МодульОбъекта", "a\r\nb\nc")
    assert (b.object_name, b.form_name, b.text, b.file_size) == ("Order", "Main", "ж", 1)
    assert (c.object_kind, c.object_name, c.module_type, c.text) == ("Конфигурация", "", "МодульСеанса", "//") and len(rows) == 3
    assert module_files(spark, str(tmp_path)).filter("object_name = 'Теst'").select(line_range(F.col("text"), 2, 9)).first()[0] == "b\nc"


def test_text_diff(spark):
    rows = [("a\nb", "a\nc"), ("a", "a"), (None, "x"), ("x", None), (None, None)]
    out = spark.createDataFrame(rows, "o string, n string").select("o", "n", diff.unified_diff("o", "n").alias("d"), diff.text_status(F.col("o"), F.col("n")).alias("s")).collect()
    assert [r.s for r in out] == ["changed", "same", "added", "removed", "missing"]
    for r in out:
        assert r.d == "\n".join(difflib.unified_diff((r.o or "").split("\n") if r.o else [], (r.n or "").split("\n") if r.n else [], "old", "new", lineterm=""))


def test_streams(spark, tmp_path):
    schema = "relative_path string, file_hash string, ts timestamp"
    for i, rows in enumerate(([("a", "1"), ("b", "1")], [("a", "1"), ("b", "2")], [("a", "1"), ("c", "1")])):
        spark.createDataFrame(rows, "relative_path string, file_hash string").withColumn("ts", F.lit(f"2024-01-0{i + 1} 00:00:00").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run(frame, name, mode):
        query = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return sorted(tuple(r) for r in spark.table(name).collect())

    found = run(changes.new_versions(stream()).select("relative_path", "file_hash"), "versions", "append")
    assert found == [("a", "1"), ("b", "1"), ("b", "2"), ("c", "1")]
    counts = run(changes.windowed_counts(stream(), "ts", "relative_path", "10 days", "1 day").select("relative_path", "n"), "counts", "complete")
    assert counts == [("a", 3), ("b", 2), ("c", 1)]


def test_refresh_begins_behind_what_was_done(spark, tmp_path):
    rows = lambda *names: spark.createDataFrame([(n,) for n in names], "name string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    stream = lambda: spark.readStream.schema("name string").parquet(str(tmp_path / "in"))
    for names in (("a", "b"), (), ("c",)):
        if names:
            rows(*names)
        assert changes.refresh(stream(), lambda batch, _: seen.append(sorted(r.name for r in batch.collect())), str(tmp_path / "done"), 120)
    assert [s for s in seen if s] == [["a", "b"], ["c"]]
