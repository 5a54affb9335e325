"""An index of a small configuration with an extension, from files to answers."""

import pytest
from test_dump import BOTH, PAGES, STRING, attribute, book, object_file, text

from pyspark.sql import functions as F

from quarry import ingest, tools
from quarry.functions.text import refers_to
from quarry.operators import lifecycle, search
from quarry.sources import help as books
from quarry.sources import reports

STOCK = """// Counts goods.
Function Count(Item) Export
    Return Helper(Item);
EndFunction
Function Helper(Item)
    Log("x"); Missing.Do(1); Stock.Gone();
    Return StrFind(Item, "a");
EndFunction
Procedure Log(Text) Export
EndProcedure
"""
ORDER = """#Region Events
&AtServer
Procedure BeforeWrite(Cancel)
    Number = Stock.Count(Items); Stock.Helper(1); Catalogs.Items.Fill();
EndProcedure
#EndRegion
"""
EXT = """&Around("BeforeWrite")
Procedure Ext_BeforeWrite(Cancel)
    ProceedWithCall(Cancel);
EndProcedure
"""


def write(root, files):
    for path, body in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(body, "utf-8")


def configuration(name, listed):
    return object_file("Configuration", f"<Name>{name}</Name><ScriptVariant>English</ScriptVariant><CompatibilityMode>Version8_3_24</CompatibilityMode>", listed)


def dump_files(stock=STOCK, order=ORDER, extra=""):
    return {
        "Configuration.xml": configuration("Main", "<Catalog>Items</Catalog><Document>Order</Document><CommonModule>Stock</CommonModule><Report>Sales</Report>"),
        "Catalogs/Items.xml": object_file("Catalog", f"<Name>Items</Name>{text([('ru', 'Номенклатура товаров')])}<CodeLength>9</CodeLength>", attribute("Attribute", "Title", STRING) + extra),
        "Catalogs/Items/Ext/ManagerModule.bsl": "Procedure Fill() Export\nEndProcedure\n",
        "Documents/Order.xml": object_file("Document", f"<Name>Order</Name>{text([('ru', 'Заказ')])}", attribute("Attribute", "Goods", BOTH)),
        "Documents/Order/Ext/ObjectModule.bsl": order,
        "CommonModules/Stock.xml": object_file("CommonModule", "<Name>Stock</Name>"),
        "CommonModules/Stock/Ext/Module.bsl": stock,
        "Reports/Sales.xml": object_file("Report", "<Name>Sales</Name>", "<Template>Main</Template>"),
        "Reports/Sales/Templates/Main.xml": object_file("Template", "<Name>Main</Name><TemplateType>DataCompositionSchema</TemplateType>"),
        "Reports/Sales/Templates/Main/Ext/Template.xml": "<schema><dataSet><name>A</name><query>SELECT * FROM Catalog.Items</query></dataSet></schema>",
    }


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("index")
    write(root / "main", dump_files())
    write(root / "ext", {"Configuration.xml": configuration("Ext", "<Document>Order</Document>"), "Documents/Order.xml": object_file("Document", "<Name>Order</Name>"), "Documents/Order/Ext/ObjectModule.bsl": EXT})
    (root / "help").mkdir()
    (root / "help" / "shcntx.hbk").write_bytes(book(PAGES))
    sources = [ingest.Source("main", "Main", "main", str(root / "main")), ingest.Source("ext", "Extension", "extension", str(root / "ext"))]
    ingest.build(spark, sources, str(root / "built"), "one")
    glossary = spark.createDataFrame([("1", "Справочник.Items", "object", ["goods list"], "", "", "")], "id string, target string, target_kind string, terms array<string>, note string, author string, updated_at string")
    index = tools.Index(ingest.opened(spark, str(root / "built")), books.entries(spark, str(root / "help"), "8.3.27").persist(), glossary, "8.3.24")
    return index, sources, root


def test_index(spark, made):
    index, sources, root = made
    assert tuple(tools.get_index_status(index).first())[:3] == (5, 4, 6)
    resolved = {(r.caller, r.callee, r.kind): r.confidence for r in index["resolved"].collect()}
    assert resolved["Count", "Helper", "local"] == "exact" and resolved["BeforeWrite", "Count", "common_module"] == "exact" and resolved["BeforeWrite", "Fill", "manager"] == "exact"
    assert resolved["Ext_BeforeWrite", "BeforeWrite", "override"] == "override" and resolved["Helper", "Do", "common_module"] is None
    assert ingest.is_current(index.tables, sources) and lifecycle.current(spark, str(root / "built")) == "one"
    assert tools.stale(index, sources).count() == 0 and [r.source_id for r in tools.list_sources(index).collect()] == ["ext", "main"]


def test_searches(made):
    index, _, _ = made
    names = lambda rows, c="object": [r[c] for r in rows.collect()]
    assert names(tools.search_metadata(index, "номенклатура товаров"))[0] == "Справочник.Items" and names(tools.search_metadata(index, "goods list"))[0] == "Справочник.Items"
    assert names(tools.search_metadata(index, "order", kind="catalog")) == [] and names(tools.list_objects(index, "Document")) == ["Документ.Order"] * 2
    assert names(tools.search_attributes(index, "title"), "attribute") == ["Title"] and names(tools.find_references(index, "Catalog.Items"), "attribute") == ["Goods"]
    assert names(tools.search_procedures(index, "count"), "procedure") == ["Count"] and names(tools.search_procedures(index, "log", export_only=True), "procedure") == ["Log"]
    found = tools.semantic_search_code(index, "counts goods").collect()
    assert found and found[0].procedure == "Count" and found[0]["rank"] == 1
    code = tools.search_code(index, "StrFind").collect()
    assert [(r.module, r.line) for r in code] == [("ОбщийМодуль.Stock.Модуль", 7)] and "StrFind" in code[0].context
    assert names(tools.knowledge_sources(index), "report") == ["Отчет.Sales"] and tools.knowledge_sources(index, "Catalog").first().used_by == ["Отчет.Sales"]
    page = tools.get_object_details(index, "справочник.items").first()
    assert page.synonym == "Номенклатура товаров" and page.fields[2] == "Код (Строка 9)" and page.entries[0].target == "Справочник.Items"


def test_code(made):
    index, _, _ = made
    assert [r.code.split("\n")[0] for r in tools.get_procedure_code(index, "Stock", "helper").collect()] == ["Function Helper(Item)"]
    context = {(r.side, r.name) for r in tools.get_procedure_context(index, "Stock", "Helper").collect()}
    assert ("caller", "ОбщийМодуль.Stock.Модуль.Count") in context and ("callee", "ОбщийМодуль.Stock.Модуль.Log") in context and ("unresolved", "Missing.Do") in context
    assert [r.procedure for r in tools.get_module_outline(index, "stock").collect()] == ["Count", "Helper", "Log"]
    tree = tools.get_call_tree(index, "BeforeWrite", "Документ.Order", depth=3).collect()
    assert [(r.depth, r.name.split(".")[-1]) for r in tree if r.depth][:2] == [(1, "Count"), (2, "Helper")]
    up = tools.get_call_tree(index, "Log", direction="up").collect()
    assert [r.name.split(".")[-1] for r in up] == ["Log", "Helper", "BeforeWrite", "Ext_BeforeWrite", "Count", "BeforeWrite"] and up[3].confidence == "override"


def test_checks(made):
    index, _, _ = made
    broken = {(r.caller, r.callee): r.problem for r in tools.find_broken_calls(index).collect()}
    assert broken == {("Helper", "Do"): "external", ("Helper", "Gone"): "missing", ("BeforeWrite", "Helper"): "not_export"}
    assert tools.find_broken_calls(index, "order").count() == 1
    verdicts = {r.snippet.split("(")[0]: r.level for r in tools.check_platform_calls(index).collect()}
    assert "StrFind" not in verdicts and "Stock.Count" not in verdicts
    assert tools.platform_help(index, "ValueTable.Count").first().warning is not None
    report = tools.diagnose_index(index)
    assert report["completeness"].count() == 0 and report["resolution"].filter("kind is null").first().total > 5 and report["interceptors"].first().procedures == 1


def test_changes(spark, made):
    index, _, root = made
    new = STOCK.replace("Return Helper(Item);", "Return 2;").replace("Procedure Log(Text)", "Procedure Log(Text, More)")
    write(root / "next", dump_files(new, extra=attribute("Attribute", "Extra", STRING)))
    write(root / "release", dump_files(STOCK.replace("Return Helper(Item);", "Return 3;"), ORDER.replace("Stock.Helper(1); ", "")))
    built = lambda name: tools.Index(ingest.build(spark, [ingest.Source("main", "Main", "main", str(root / name))], str(root / "other"), name, publish=False))
    ours, release = built("next"), built("release")
    changes = {(r.part, r.name): r.change for r in tools.diff_from_base(ours, index).collect()}
    assert changes == {("module", "ОбщийМодуль.Stock.Модуль"): "changed", ("procedure", "Count"): "changed", ("procedure", "Log"): "changed", ("attribute", "Extra"): "added"}
    both = tools.Index(ours.tables | {"resolved": index["resolved"], "procedures": ours["procedures"].unionByName(index["procedures"].filter("source_id = 'ext'"))})
    conflicts = {(r.kind, r.target) for r in tools.update_conflicts(both, index, release).collect()}
    assert ("both_changed", "ОбщийМодуль.Stock.Модуль.Count") in conflicts and ("intercepted_changed", "Документ.Order.МодульОбъекта.BeforeWrite") in conflicts
    text_diff = tools.diff_procedure(ours, index, "Stock", "Count").first()
    assert text_diff.status == "changed" and "+    Return 2;" in text_diff["diff"]
    counts = tools.remove_source(index, "ext").first()
    assert counts.procedures == 1 and tools.remove_source(index, "ext", confirm=True)["procedures"].count() == 5
    kept, unknown = tools.add_glossary_term(index, spark.createDataFrame([("stock.count", "", ["quantity"], "", "me", "t"), ("Nothing", "", ["x"], "", "me", "t")], "target string, target_kind string, terms array<string>, note string, author string, updated_at string"))
    assert {r.target for r in kept.collect()} == {"Справочник.Items", "ОбщийМодуль.Stock.Модуль.Count"} and [r.target for r in unknown.collect()] == ["Nothing"]
    assert tools.list_glossary(index, "goods list").count() == 1 and tools.remove_glossary_term(index, "1").count() == 0


def test_texts(spark, made):
    index, _, _ = made
    tree = reports.tree_text(tools.get_call_tree(index, "BeforeWrite", "Документ.Order", depth=2)).split("\n")
    assert tree[0].endswith("BeforeWrite") and tree[1].startswith("  ОбщийМодуль.Stock.Модуль.Count (line 4") and tree[2].startswith("    ")
    page = reports.object_text(tools.get_object_details(index, "Справочник.Items")).split("\n")
    assert page[0] == "Справочник.Items - Номенклатура товаров" and page[1] == "  Title: String(25, Variable)" and reports.object_text(tools.get_object_details(index, "Nothing")) == "No such object"
    assert reports.broken_text(tools.find_broken_calls(index), "not_export") == "Документ.Order.МодульОбъекта.BeforeWrite, line 4: Stock.Helper"
    entry = tools.platform_help(index, "ValueTable.Count").first().asDict(recursive=True)
    shown = reports.help_text(entry, warning=entry["warning"])
    assert shown.startswith("ТаблицаЗначений.Количество (Count)") and "needs mode 8.3.26" in shown and "А: Строка, Число" in shown
    changes = tools.diff_from_base(index, index)
    assert reports.diff_report(changes).count() == 0 and reports.diff_report(changes).columns[0] == "change"
    rows = spark.createDataFrame([("name_clash", "B", "t", "", 4, "x"), ("both_changed", "A", "t", "", 0, "y")], "kind string, object string, target string, note string, rank int, advice string")
    assert [r.kind for r in reports.conflict_report(rows).collect()] == ["both_changed", "name_clash"]
    key = index["procedures"].select(tools.procedure_key("source_id", F.upper("module"), F.lower("procedure")).alias("k"), tools.procedure_key("source_id", "module", "procedure").alias("l")).collect()
    assert all(r.k == r.l and len(r.k) == 21 for r in key) and len({r.k for r in key}) == len(key)
    files = index["modules"].select("source_id", F.col("relative_path").alias("file_path"), F.lit(True).alias("is_export"))
    assert search.filtered(files, "main", "STOCK", True).count() == 1 and search.filtered(files).count() == 4
    typed = spark.createDataFrame([("CatalogRef.Items, String(5, Fixed)",), ("CatalogRef.Item",), ("Boolean",)], "t string")
    assert [r.r for r in typed.select(refers_to(F.col("t"), "Catalog", "items").alias("r")).collect()] == [True, False, False]
    best = search.top_per_group(index["procedures"], ["module"], [F.col("start_line")], 1)
    assert best.count() == index["procedures"].select("module").distinct().count()
