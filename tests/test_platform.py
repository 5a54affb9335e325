"""Preprocessor, guards, sites and verdicts of the platform check; the life of an index."""

from pyspark.sql import functions as F

from quarry.functions import platform_calls as P
from quarry.operators import checks, lifecycle, platform, snapshots
from quarry.operators.platform import LEVELS


def test_conditions():
    assert P.environments("Server Then") == (P.SERVER, P.ALL ^ P.SERVER) and P.environments("Not Server Then") == (P.ALL ^ P.SERVER, P.SERVER)
    assert P.environments("Сервер Или ТонкийКлиент Тогда") == (P.SERVER | 1, P.ALL ^ P.SERVER ^ 1) and P.environments("Client And Not WebClient Then") == (P.CLIENT ^ 2, P.ALL ^ P.CLIENT | 2)
    assert P.environments("(Server Or Unknown) Then")[0] == P.ALL and P.environments("Server") == (P.ALL, P.ALL) and P.environments("( Then") == (P.ALL, P.ALL)


def found(text):
    return {(s.line, s.name): s for s in P.sites(text)}


def test_sites():
    s = found("""&AtClient
Procedure A(Param)
    StrFind("fake()", B.Second(1)); // none()
    T = New ValueTable();
    T.Count();
    Fill(T);
    T.After();
    #If Server Then
    OnServer();
    #Else
    OnClient();
    #EndIf
    Param.Method(); Catalogs.Items.Find(1); x = New Map(1);
    T = New Array;
    If T.Count() Then T.Inside(); EndIf;
    A(1)[0].Get();
EndProcedure
Outside();""")
    assert s[3, "strfind"].receiver == [] and s[3, "strfind"].client and s[3, "second"].receiver == ["b"] and (3, "none") not in s and (3, "fake") not in s
    assert s[5, "count"].binding == "valuetable" and s[7, "after"].binding == "" and not s[9, "onserver"].client and s[11, "onclient"].client
    assert s[13, "method"].binding == "" and s[13, "find"].receiver == ["catalogs", "items"] and (13, "map") not in s
    assert s[15, "count"].binding == "" and s[15, "inside"].binding == "" and s[16, "get"].receiver[0] == "…" and not s[18, "outside"].client


def test_guards():
    text = """Procedure A()
    If Metadata.Catalogs.Find("Items") <> Undefined Then
        Catalogs.Items.Inside();
    Else
        Catalogs.Items.Other();
    EndIf;
    Catalogs.Items.After();
    If Not Metadata.Catalogs.Contains(Metadata.Catalogs.Items) Then
        Return;
    EndIf;
    Catalogs.Items.Proven();
    M = Metadata.FindByFullName("Document.Order");
    If M = Undefined Then
        Raise "no";
    EndIf;
    Documents.Order.Proven2();
    While True Do
        Documents.Order.InLoop();
    EndDo;
EndProcedure"""
    s = {x.name: x.guarded for x in P.sites(text)}
    assert s["inside"] == ["справочник.items"] and s["other"] == [] and s["after"] == [] and s["proven"] == ["справочник.items"]
    assert s["proven2"] == ["документ.order", "справочник.items"] and s["inloop"] == s["proven2"]


ENTRY = "kind string, name_ru string, name_en string, owner_ru string, owner_en string, since string, compat string, availability string, value_type string"
HELP = [
    ("function", "СтрНайти", "StrFind", "Глобальный контекст", "Global context", "", "", "Сервер, тонкий клиент", ""), ("function", "Новая", "NewOne", "Глобальный контекст", "Global context", "8.3.25", "", "", ""),
    ("function", "НаСервере", "ServerOnly", "Глобальный контекст", "Global context", "", "", "Сервер", ""), ("type", "ТаблицаЗначений", "ValueTable", "", "", "", "", "", ""),
    ("method", "Количество", "Count", "ТаблицаЗначений", "ValueTable", "", "", "", ""), ("property", "Колонки", "Columns", "ТаблицаЗначений", "ValueTable", "", "", "", "КоллекцияКолонок"),
    ("method", "Добавить", "Add", "КоллекцияКолонок", "ColumnCollection", "", "", "", ""), ("method", "НайтиПоКоду", "FindByCode", "СправочникМенеджер.<Имя>", "CatalogManager.<Name>", "", "", "", ""),
    ("global_property", "Таблица", "ExampleTable", "Глобальный контекст", "Global context", "8.3.27", "", "", "ТаблицаЗначений"),
]


def test_verdicts(spark):
    text = """&AtClient
Procedure A()
    StrFind(1); Typo(1); NewOne(); ServerOnly(); A2(); Shared();
    T = New ValueTable; T.Count(); T.Gone(); T.Columns.Add(); Unknown.Do();
    Catalogs.Items.FindByCode(1); Catalogs.Items.Custom(); Catalogs.Items.Hidden(); Catalogs.Gone.FindByCode(1); Helpers.Do(); ExampleTable.Count();
    If Metadata.Catalogs.Find("Gone") <> Undefined Then Catalogs.Gone.Custom(); EndIf;
EndProcedure
Procedure A2()
EndProcedure"""
    modules = spark.createDataFrame([("main", "ОбщийМодуль.M.Модуль", text, [])], "source_id string, module string, text string, attributes array<string>")
    procedures = spark.createDataFrame([("main", "ОбщийМодуль.M.Модуль", "A2", False), ("main", "ОбщийМодуль.G.Модуль", "Shared", True), ("main", "Справочник.Items.МодульМенеджера", "Custom", True), ("main", "Справочник.Items.МодульМенеджера", "Hidden", False), ("main", "ОбщийМодуль.Helpers.Модуль", "Do", True)], "source_id string, module string, procedure string, is_export boolean")
    globals_ = spark.createDataFrame([("main", "ОбщийМодуль.G.Модуль", True)], "source_id string, module string, is_global boolean")
    known = spark.createDataFrame([("Справочник.Items",)], "object string")
    entries = spark.createDataFrame(HELP, ENTRY)
    rows = platform.check(P.sites_of(modules), entries, procedures, globals_, known, "8.3.24").collect()
    verdicts = {(r.line, r.snippet.split("(")[0]): (r.level, r.reason) for r in rows}
    assert {k: v[0] for k, v in verdicts.items()} == {
        (3, "Typo"): "error", (3, "NewOne"): "warning", (3, "ServerOnly"): "warning", (4, "T.Gone"): "error", (4, "Unknown.Do"): "unchecked", (5, "Catalogs.Items.Hidden"): "error", (5, "Catalogs.Gone.FindByCode"): "error",
        (5, "ExampleTable.Count"): "warning", (6, "Catalogs.Gone.Custom"): "warning", (6, "Metadata.Catalogs.Find"): "unchecked",
    }
    assert "8.3.25" in verdicts[3, "NewOne"][1] and "clients" in verdicts[3, "ServerOnly"][1] and "guard" in verdicts[6, "Catalogs.Gone.Custom"][1] and "receiver" in verdicts[5, "ExampleTable.Count"][1]


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("s", f"m{i % 7}", i, 1, "x()", LEVELS[i % 2], "r") for i in range(300)], "source_id string, module string, place int, line int, snippet string, level string, reason string")
    platform.write_report(rows, str(tmp_path / "r"), 5)
    report = spark.read.parquet(str(tmp_path / "r"))
    assert [tuple(r) for r in platform.level_counts(report).collect()] == [("error", 150), ("warning", 150), ("unchecked", 0)]
    key = lambda r: (r.source_id, r.module, r.place)
    wanted = sorted(map(key, rows.collect()))
    assert [key(r) for r in platform.page(report, None, 20, 35).collect()] == wanted[35:55]
    errors = sorted(key(r) for r in rows.filter("level = 'error'").collect())
    assert [key(r) for r in platform.page(report, ["error"], 20, 140).collect()] == errors[140:160]
    ranges = platform.source_ranges(report).collect()
    assert {(r.level, r["first"], r["last"]) for r in ranges} == {("error", 0, 149), ("warning", 0, 149)}


def test_named_directly(spark):
    rows = [("", True), ("M.Run(1)", True), ("x = m . run (1)", True), ("Alias.Run(1)", False), ("NoM.Run(1)", False), ("M.Runner(1)", False)]
    found = spark.createDataFrame(rows, "c string, w boolean").select("w", checks.named_directly(F.col("c"), F.lit("M"), F.lit("Run")).alias("d")).collect()
    assert all(r.w == r.d for r in found)
    texts = spark.createDataFrame([("s", "m", 'A = Eval("x"); B.C = Eval("y"); Модуль = Вычислить ("z");')], "source_id string, module string, text string")
    assert {r.callee_module for r in checks.evaluated_names(texts).collect()} == {"A", "Модуль"}


def test_external_and_dynamic_modules(spark):
    resolved = spark.createDataFrame([(1, "s", "M", "P", 1, "common_module", "Lib", "Run", None, ""), (2, "s", "M", "P", 2, "common_module", "Lib", "Go", None, ""), (3, "s", "M", "P", 3, "common_module", "Var", "Go", None, ""), (4, "s", "M", "P", 4, "common_module", "Ссылка", "Go", None, "")], "call_id long, source_id string, module string, caller string, line int, kind string, callee_module string, callee string, target long, context string")
    procedures = spark.createDataFrame([(9, "s", "M", "P", True)], "proc_id long, source_id string, module string, procedure string, is_export boolean")
    broken = checks.broken_calls(resolved, procedures, evaluated=spark.createDataFrame([("Var",)], "callee_module string"))
    assert {r.call_id: r.problem for r in broken.collect()} == {1: "external", 2: "external", 3: "dynamic"}
    assert [(r.callee_module, r.calls, r.methods, r.sample.line) for r in checks.external_modules(broken).collect()] == [("Lib", 2, 2, 1)]
    assert checks.in_order(broken, "external").count() == 2


# -- life of an index -----------------------------------------------------------------------------------------------------


def test_snapshots_are_replaced_and_published(spark, tmp_path):
    files = spark.createDataFrame([("a", 1, 1, "h1", "p"), ("b", 1, 1, "h2", "p"), ("c", 1, 1, "h3", "old"), ("d", 1, 1, "h4", "p")], "relative_path string, file_size int, mtime int, file_hash string, parser string")
    now = spark.createDataFrame([("a", 1, 1, None), ("b", 1, 2, "h2"), ("c", 1, 1, None), ("e", 1, 1, "h5")], "relative_path string, file_size int, mtime int, file_hash string")
    plan = {r.relative_path: r.action for r in lifecycle.plan_files(files, now, "p").collect()}
    assert plan == {"a": "keep", "b": "touch", "c": "read", "d": "delete", "e": "read"}
    tables = {"files": files, "procedures": spark.createDataFrame([("a", "x"), ("c", "y"), ("d", "z")], "relative_path string, name string")}
    read, gone = (spark.createDataFrame([(k,) for k, v in plan.items() if v == w], "relative_path string") for w in ("read", "delete"))
    after = lifecycle.replace(tables, {"procedures": spark.createDataFrame([("c", "y2"), ("e", "w")], "relative_path string, name string")}, read, gone, "relative_path")
    assert {tuple(r) for r in after["procedures"].collect()} == {("a", "x"), ("c", "y2"), ("e", "w")} and {r.relative_path for r in after["files"].collect()} == {"a", "b"}
    root = str(tmp_path / "index")
    assert lifecycle.current(spark, root) is None
    for name in ("one", "two"):
        lifecycle.write_tables(after, f"{root}/{name}")
        lifecycle.publish(spark, root, name)
        assert lifecycle.current(spark, root) == name
    seeded = lifecycle.seeded(tables, spark.createDataFrame([("a", "h1"), ("b", "other")], "relative_path string, file_hash string"))
    assert {r.name for r in seeded["procedures"].collect()} == {"x"}
    build = lambda f: f.select("relative_path", F.upper("file_hash").alias("x"))
    assert lifecycle.backfill(None, files, build).count() == 4 and {r.x for r in lifecycle.backfill(spark.createDataFrame([("a", "kept")], "relative_path string, x string"), files, build).collect()} == {"kept", "H2", "H3", "H4"}
    parted = spark.createDataFrame([("m", 1), ("e", 2)], "source_id string, n int")
    lifecycle.replace_partition(parted, str(tmp_path / "p"))
    lifecycle.replace_partition(spark.createDataFrame([("e", 3)], "source_id string, n int"), str(tmp_path / "p"))
    assert {(r.source_id, r.n) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {("m", 1), ("e", 3)}


def test_results_are_kept_by_state(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(len(calls))

    for states, n in ((["a", "b"], 1), (["a", "b"], 1), (["a", "c"], 2), (["a", "b"], 1)):
        assert lifecycle.cached(spark, str(tmp_path), "diff", states, build).count() == n
    assert len(calls) == 2


def test_states(spark):
    none = spark.createDataFrame([], "relative_path string")
    state = lifecycle.graph_state(spark, "r1")
    assert not lifecycle.graph_stale(state, "r1", none) and lifecycle.graph_stale(state, "r2", none) and lifecycle.graph_stale(state.limit(0), "r1", none)
    assert lifecycle.graph_stale(lifecycle.graph_state(spark, "r1", True), "r1", none) and lifecycle.graph_stale(state, "r1", spark.createDataFrame([("a",)], "relative_path string"))
    assert lifecycle.fingerprint(snapshots, "x") != lifecycle.fingerprint(snapshots, "y") and len(lifecycle.fingerprint(snapshots.changes)) == 16
    a = spark.createDataFrame([("k", "v", 1), ("l", "w", 2)], "key string, x string, y int").withColumn("digest", lifecycle.digest("x", "y"))
    b = spark.createDataFrame([("k", "v", 1), ("l", "w", 3), ("m", "z", 1)], "key string, x string, y int").withColumn("digest", lifecycle.digest("x", "y"))
    assert {r.key for r in lifecycle.changed_keys(a, b, ["key"]).collect()} == {"l", "m"}
    assert {r.relative_path: r.state for r in checks.stale_files(spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "relative_path string, file_hash string"), spark.createDataFrame([("a", "1"), ("b", "2")], "relative_path string, file_hash string")).collect()} == {"b": "changed", "c": "gone"}
    ready = spark.createDataFrame([("s", [])], "source_id string, issues array<string>")
    assert '"ready":true' in lifecycle.manifest(ready, spark.createDataFrame([(3,)], "objects int")).first().json
    assert [t.count() for t in lifecycle.without_source({"a": a.withColumn("source_id", F.lit("s"))}, "s").values()] == [0]


def test_conflicts_with_intercepts(spark):
    schema = "object string, module string, part string, name string, change string, was string, now string, n long"
    ours = spark.createDataFrame([], schema)
    release = spark.createDataFrame([("O", "O.M", "module", "O.M", "changed", "1", "2", 0), ("O", "O.M", "procedure", "P", "changed", "s", "s", 1), ("O", "O.M", "procedure", "Q", "changed", "s", "t", 1), ("O", "O.M", "procedure", "R", "removed", "s", None, 1)], schema)
    taken = spark.createDataFrame([("O.M", p, "ext", f"Ext_{p}", d) for p, d in (("P", "&AtServer &Around:P"), ("Q", "&After:Q"), ("R", "&Before:R"), ("S", "&After:S"))], "module string, procedure string, source_id string, ext_procedure string, directive string")
    found = snapshots.by_severity(snapshots.conflicts(ours, release, taken)).collect()
    assert [(r.kind, r.target, r.note) for r in found] == [("intercepted_removed", "O.M.R", "ext: Ext_R; removed"), ("intercepted_changed", "O.M.P", "ext: Ext_P; replaced wholly"), ("intercepted_changed", "O.M.Q", "ext: Ext_Q; new signature")]
