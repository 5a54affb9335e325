"""Configuration dumps, help containers, archives and small JSON files."""

import io
import json
import struct
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from quarry.operators import objects
from quarry.sources import archives, dump
from quarry.sources import help as books

V8 = 'xmlns:v8="http://v8.1c.ru/8.1/data/core"'


def text(value, tag="Synonym"):
    items = "".join(f"<v8:item><v8:lang>{lang}</v8:lang><v8:content>{content}</v8:content></v8:item>" for lang, content in value)
    return f"<{tag}>{items}</{tag}>"


def attribute(tag, name, type_, extra=""):
    return f'<{tag}><Properties><Name>{name}</Name>{text([("en", name + " en"), ("ru", name + " ru")])}<Comment>c</Comment><Type>{type_}</Type>{extra}</Properties></{tag}>'


def object_file(tag, properties, children=""):
    return f"<MetaDataObject {V8}><{tag}><Properties>{properties}</Properties><ChildObjects>{children}</ChildObjects></{tag}></MetaDataObject>"


STRING = "<v8:Type>xs:string</v8:Type><v8:StringQualifiers><v8:Length>25</v8:Length><v8:AllowedLength>Variable</v8:AllowedLength></v8:StringQualifiers>"
NUMBER = "<v8:Type>xs:decimal</v8:Type><v8:NumberQualifiers><v8:Digits>10</v8:Digits><v8:FractionDigits>2</v8:FractionDigits><v8:AllowedSign>Nonnegative</v8:AllowedSign></v8:NumberQualifiers>"
BOTH = "<v8:Type>cfg:CatalogRef.Items</v8:Type><v8:Type>xs:dateTime</v8:Type><v8:DateQualifiers><v8:DateFractions>Date</v8:DateFractions></v8:DateQualifiers><v8:Type>v8:ValueListType</v8:Type>"


def make(root, script):
    def put(path, body):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(body, "utf-8-sig")

    listed = "<Catalog>Items</Catalog><Document>Order</Document><Report>Sales</Report><CommonModule>Stock</CommonModule><Subsystem>Trade</Subsystem><Catalog>Broken</Catalog><Catalog>Absent</Catalog>"
    put("Configuration.xml", object_file("Configuration", f"<Name>Demo</Name>{text([('en', 'Demo')])}<Version>1.2</Version><ScriptVariant>{script}</ScriptVariant><CompatibilityMode>Version8_3_24</CompatibilityMode>", listed))
    section = f"<TabularSection><Properties><Name>Rows</Name></Properties><ChildObjects>{attribute('Attribute', 'Price', NUMBER)}</ChildObjects></TabularSection>"
    put("Catalogs/Items.xml", object_file("Catalog", f"<Name>Items</Name>{text([('en', 'Items'), ('ru', 'Товары')])}<CodeLength>9</CodeLength><Hierarchical>true</Hierarchical><DescriptionLength>0</DescriptionLength><Owners><Item>Catalog.Firms</Item><Item>01234567-89ab-cdef-0123-456789abcdef</Item></Owners>", attribute("Attribute", "Title", STRING, "<Indexing>Index</Indexing><FillChecking>ShowError</FillChecking>") + attribute("Attribute", "Link", BOTH) + section + "<Form>Main</Form>"))
    put("Catalogs/Unlisted.xml", object_file("Catalog", "<Name>Unlisted</Name>"))
    put("Catalogs/Broken.xml", "<MetaDataObject><Catalog>")
    put("Catalogs/Items/Ext/Help/en.html", "<html><head><title>t</title></head><body><p>Goods &amp; wares</p><script>x</script><ul><li>One</li></ul></body></html>")
    put("Catalogs/Items/Forms/Main/Ext/Form.xml", f'<Form {V8}><Events><Event name="OnOpen">Opened</Event></Events><Attributes><Attribute name="Object"><Type>{STRING}</Type></Attribute><Attribute name="List">{text([("ru", "Список")], "Title")}</Attribute></Attributes><ChildItems><Button name="Save"><Events><Event name="Click" callType="After">Ext_Click</Event></Events></Button></ChildItems><BaseForm><Attributes><Attribute name="object"/><Attribute name="Old"/></Attributes></BaseForm></Form>')
    put("Documents/Order.xml", object_file("Document", "<Name>Order</Name><Posting>Allow</Posting><NumberLength>11</NumberLength><RegisterRecords><Item>AccumulationRegister.Stock</Item></RegisterRecords>", "<EnumValue><Properties><Name>V</Name></Properties></EnumValue>"))
    put("Reports/Sales.xml", object_file("Report", "<Name>Sales</Name>", "<Template>Main</Template>"))
    put("Reports/Sales/Templates/Main.xml", object_file("Template", "<Name>Main</Name><TemplateType>DataCompositionSchema</TemplateType>"))
    put("Reports/Sales/Templates/Main/Ext/Template.xml", "<schema><dataSet><name>A</name><query>SELECT * FROM Catalog.Items AS I, AccumulationRegister.Stock.Balance(,)</query><item><name>B</name><query>SELECT Документ.Order.Ref, I.Catalog.X</query></item></dataSet></schema>")
    put("CommonModules/Stock.xml", object_file("CommonModule", "<Name>Stock</Name><Global>true</Global><Server>false</Server>"))
    put("Subsystems/Trade.xml", object_file("Subsystem", "<Name>Trade</Name><Content><Item>Catalog.Items</Item></Content>", "<Subsystem>Retail</Subsystem>"))
    put("Subsystems/Trade/Subsystems/Retail.xml", object_file("Subsystem", "<Name>Retail</Name>"))


def test_dump(spark, tmp_path):
    make(tmp_path, "English")
    assert tuple(dump.probe(spark, str(tmp_path)).first()) == (True, True, "8.3.24")
    files = dump.parsed(spark, str(tmp_path)).persist()
    known = {r.object: r for r in dump.objects(files).collect()}
    assert set(known) == {"Справочник.Items", "Документ.Order", "Отчет.Sales", "ОбщийМодуль.Stock", "Подсистема.Trade", "Подсистема.Trade.Subsystems.Retail"}
    assert known["Справочник.Items"].synonym == "Товары" and known["Справочник.Items"].help == "Goods & wares\nOne"
    rows = {(r.object, r.attribute): r for r in dump.attributes(files).collect()}
    title = rows["Справочник.Items", "Title"]
    assert (title.type_desc, title.synonym, title.is_indexed, title.check_fill) == ("String(25, Variable)", "Title ru", True, "ShowError")
    assert rows["Справочник.Items", "Link"].type_desc == "CatalogRef.Items, Date(Date), ValueList" and rows["Справочник.Items", "Rows.Price"].type_desc == "Number(10, 2, Nonnegative)"
    assert rows["Справочник.Items", "Rows"].kind == "Табличная часть" and rows["Документ.Order", "V"].kind == "Значение перечисления"
    assert ("Справочник.Items", "Main") in {tuple(r) for r in dump.forms(files).collect()}
    assert {(r.key, r.value) for r in dump.properties(files).filter("object = 'Справочник.Items'").collect()} == {("CodeLength", "9"), ("Hierarchical", "true"), ("DescriptionLength", "0"), ("Owners", "Справочник.Firms")}
    assert [tuple(r) for r in dump.subsystem_content(files).collect()] == [("Подсистема.Trade", "Catalog.Items")]
    queries = dump.report_queries(files)
    assert [(r.report, r.template, r.dataset) for r in queries.orderBy("dataset").collect()] == [("Отчет.Sales", "Main", "A"), ("Отчет.Sales", "Main", "B")]
    form = {r.attribute: (r.owner, r.title, r.type_desc) for r in dump.form_attributes(files).collect()}
    assert form == {"Object": ("Catalogs/Items/Forms/Main", "", "String(25, Variable)"), "List": ("Catalogs/Items/Forms/Main", "Список", ""), "Old": ("Catalogs/Items/Forms/Main", "", "")}
    events = dump.form_events(files)
    assert {(r.element, r.event, r.handler, r.call_type) for r in events.collect()} == {("", "OnOpen", "Opened", ""), ("Save", "Click", "Ext_Click", "After")}
    main = events.withColumn("handler", F.lit("Clicked")).withColumn("call_type", F.lit(""))
    assert [tuple(r) for r in dump.event_intercepts(events, main, True).collect()] == [("Catalogs/Items/Forms/Main", "Clicked", "Ext_Click", "&After:")]
    assert files.filter("error is not null").count() == 1 and dump.known_names(files).count() == 6
    assert [r.name for r in dump.in_order(files).orderBy("place").collect()][:2] == ["Items", "Order"]
    # What the tables give together.
    sources = {r.report: r for r in objects.report_sources(queries, dump.objects(files)).collect()}
    assert sources["Отчет.Sales"].uses == ["Документ.Order", "Справочник.Items"]
    written = objects.normal_properties(dump.properties(files))
    assert ("Документ.Order", "Движения", "РегистрНакопления.Stock") in {tuple(r) for r in written.collect()}
    props = dump.objects(files).join(objects.property_maps(written), "object", "left")
    standard = {r.object: r for r in objects.standard_attributes(props).collect()}
    assert standard["Справочник.Items"].fields == ["Ссылка", "ПометкаУдаления", "Код (Строка 9)", "Родитель", "ЭтоГруппа", "Владелец (Справочник.Firms)", "Предопределенный", "ИмяПредопределенныхДанных"]
    assert standard["Справочник.Items"].absent == ["Наименование"] and standard["Документ.Order"].fields == ["Ссылка", "ПометкаУдаления", "Дата", "Номер (Строка 11)", "Проведен", "МоментВремени"]
    assert standard["Отчет.Sales"].fields is None


def test_russian_dump_and_nothing(spark, tmp_path):
    make(tmp_path / "ru", "Russian")
    files = dump.parsed(spark, str(tmp_path / "ru"))
    rows = {r.attribute: r.type_desc for r in dump.attributes(files).collect()}
    assert rows["Title"] == "Строка(25, Переменная)" and rows["Link"] == "СправочникСсылка.Items, Дата(Дата), СписокЗначений" and rows["Rows.Price"] == "Число(10, 2, Неотрицательный)"
    assert "Подсистема.Trade.Подсистемы.Retail" in {r.object for r in dump.objects(files).collect()}
    assert [r.member for r in dump.subsystem_content(files).collect()] == ["Справочник.Items"]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.xml").write_text("<x/>")
    assert tuple(dump.probe(spark, str(tmp_path / "none")).first()) == (False, False, "") and dump.objects(dump.parsed(spark, str(tmp_path / "none"))).count() == 0


def test_hints(spark):
    schema = "object string, kind string, props map<string, array<string>>, resources array<string>"
    rows = [("РегистрНакопления.A", "РегистрНакопления", {"ВидРегистра": ["Остатки"]}, ["N", "S", "T", "U"]), ("РегистрСведений.B", "РегистрСведений", {"Периодичность": ["День"], "РежимЗаписи": ["Независимый"]}, []), ("РегистрБухгалтерии.C", "РегистрБухгалтерии", {}, []), ("Справочник.D", "Справочник", {}, [])]
    found = {r.object: r.hints for r in objects.query_hints(spark.createDataFrame(rows, schema)).collect()}
    assert found["РегистрНакопления.A"][0] == "Вид регистра: остатки" and "NОстаток, SОстаток, TОстаток, …" in found["РегистрНакопления.A"][1]
    assert found["РегистрСведений.B"][0] == "Периодичность: День; запись: независимый" and "СрезПоследних" in found["РегистрСведений.B"][1]
    assert len(found["РегистрБухгалтерии.C"]) == 1 and "<Ресурс>ОстатокДт" in found["РегистрБухгалтерии.C"][0] and found["Справочник.D"] == []


def test_pages_and_registers(spark):
    known = spark.createDataFrame([("Справочник.A", "main", "Справочник", "a", ""), ("Справочник.A", "ext", "Справочник", "x", ""), ("Подсистема.S", "main", "Подсистема", "", ""), ("Подсистема.S.Подсистемы.T", "main", "Подсистема", "", ""), ("РегистрНакопления.R", "main", "РегистрНакопления", "", "")], "object string, source_id string, kind string, synonym string, comment string")
    attributes = spark.createDataFrame([("Справочник.A", "main", f"f{i:02}", "Реквизит", "String") for i in range(40)] + [("Справочник.A", "main", "Rows.x", "Реквизит", "Date")], "object string, source_id string, attribute string, kind string, type_desc string")
    forms = spark.createDataFrame([("Справочник.A", "main", "F")], "object string, source_id string, form string")
    properties = spark.createDataFrame([("Документ.D", "RegisterRecords", "РегистрНакопления.R"), ("Документ.E", "RegisterRecords", "РегистрНакопления.R"), ("Документ.E", "RegisterRecords", "РегистрНакопления.Q")], "object string, key string, value string")
    content = spark.createDataFrame([("Подсистема.S", "main", "Справочник.A")], "object string, source_id string, member string")
    found = {r.object: r for r in objects.pages(known, attributes, forms, properties, content, main_source="main").collect()}
    a = found["Справочник.A"]
    assert (len(a.attributes), a.n_attributes, a.synonym, a.other_sources, a.forms) == (30, 40, "a", ["ext"], ["F"]) and a.sections[0].section == "Rows"
    assert found["РегистрНакопления.R"].recorded_by == ["Документ.D", "Документ.E"] and found["Подсистема.S"].content == ["Справочник.A"] and found["Подсистема.S"].children == ["Подсистема.S.Подсистемы.T"]
    reports = spark.createDataFrame([("РегистрНакопления.R", ["Отчет.X"])], "object string, used_by array<string>")
    assert [tuple(r) for r in objects.registers_of_documents(properties, reports).collect()] == [("Документ.D", "РегистрНакопления.R", 2, 1), ("Документ.E", "РегистрНакопления.Q", 1, 0), ("Документ.E", "РегистрНакопления.R", 2, 1)]
    assert [r.object for r in objects.children_of(known, "Подсистема.S").collect()] == ["Подсистема.S.Подсистемы.T"]


# -- help -----------------------------------------------------------------------------------------------------------------


def block(data, page=None):
    return f"\r\n{len(data):08x} {page or len(data):08x} {books.LAST:08x} \r\n".encode() + data


def book(pages, contents=""):
    def zipped(files):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
            for name, body in files.items():
                z.writestr(name, body)
        return raw.getvalue()

    documents = {"FileStorage": zipped(pages)} | ({"PackBlock": zipped({"toc": contents})} if contents else {})
    listed = 12 * len(documents)
    out, at, triples = b"", books.LIST + books.HEADER + listed, b""
    for name, data in documents.items():
        head = block(b"\0" * 20 + name.encode("utf-16-le") + b"\0\0\0\0")
        body = block(data)
        triples += struct.pack("<III", at, at + len(head), books.LAST)
        out, at = out + head + body, at + len(head) + len(body)
    return b"\0" * books.LIST + block(triples) + out


def page(ru, en, owner=("", ""), description="Ищет строку.", version="", availability="Сервер, тонкий клиент"):
    return (
        f'<h1>{owner[0]}.{ru} ({owner[1]}.{en})</h1><p class="V8SH_title">{owner[0]} ({owner[1]})</p><p class="V8SH_heading">{ru} ({en})</p><p class="V8SH_chapter">Синтаксис:</p>{ru}(&lt;А&gt;)'
        '<p class="V8SH_chapter">Параметры:</p><div class="V8SH_rubric">&lt;А&gt; (обязательный)</div>Тип: Строка; Число.<br>Что искать.'
        f'<p class="V8SH_chapter">Описание:</p>{description}<p class="V8SH_chapter">Возвращаемое значение:</p>Тип: Число.<br>Место.<p class="V8SH_chapter">Доступность:</p>{availability}.'
        f'<p class="V8SH_chapter">Использование в версии:</p>{version}'
    )


PAGES = {
    "objects/Global context/methods/StrFind.html": page("СтрНайти", "StrFind"),
    "objects/ValueTable.html": "<h1>ТаблицаЗначений (ValueTable)</h1>",
    "objects/ValueTable/methods/Count.html": page("Количество", "Count", ("ТаблицаЗначений", "ValueTable"), "Считает строки.", "Доступен, начиная с версии 8.3.25. Доступен в режиме совместимости с версией 8.3.26.", "Сервер"),
    "objects/ValueTable/properties/Columns.html": page("Колонки", "Columns", ("ТаблицаЗначений", "ValueTable"), "Тип: КоллекцияКолонок.<br>Колонки таблицы."),
    "objects/ValueTable/ctors/Empty.html": page("По умолчанию", "", ("ТаблицаЗначений", "ValueTable")),
    "objects/CatalogManager/methods/FindByCode.html": page("НайтиПоКоду", "FindByCode", ("СправочникМенеджер.&lt;Имя&gt;", "CatalogManager.&lt;Name&gt;")),
    "objects/catalog5.html": "<h1>Раздел</h1>",
}
CONTENTS = '{2,{1,0,1,2,{"x",1,{"n",0,{"ru","Общие ""функции"""}},""}},{2,1,0,{"x",1,{"n",0,{"ru","Строки"}},"/objects/Global context/methods/StrFind.html"}}}'


def test_help(spark, tmp_path):
    (tmp_path / "shcntx.hbk").write_bytes(book(PAGES, CONTENTS))
    (tmp_path / "shquery.hbk").write_bytes(book({"KeyWordsSum.html": "<h1>СУММА</h1><p>СУММА (поле)</p><p>Складывает &amp; считает.</p>"}))
    (tmp_path / "bad.hbk").write_bytes(b"no container")
    rows = books.entries(spark, str(tmp_path), "8.3.27").persist()
    assert [r.book for r in rows.filter("error is not null").collect()] == ["bad.hbk"]
    found = {r.path: r for r in rows.filter("error is null").collect()}
    assert len(found) == 7 and found["KeyWordsSum.html"].kind == "query" and found["KeyWordsSum.html"].description == "Складывает & считает." and found["KeyWordsSum.html"].variants[0].syntax == "СУММА (поле)"
    find, count = found["objects/Global context/methods/StrFind.html"], found["objects/ValueTable/methods/Count.html"]
    assert (find.kind, find.name_ru, find.owner_en, find.section, find.returns_types, find.returns) == ("function", "СтрНайти", "Global context", 'Общие "функции"', "Число", "Место.")
    assert find.variants[0].params[0].asDict() == {"name": "А", "required": True, "types": ["Строка", "Число"], "description": "Что искать."}
    assert (count.owner_ru, count.since, count.compat, count.availability) == ("ТаблицаЗначений", "8.3.25", "8.3.26", "Сервер")
    assert found["objects/ValueTable/properties/Columns.html"].value_type == "КоллекцияКолонок" and found["objects/ValueTable/ctors/Empty.html"].name_en == "Empty"
    names = lambda q, *a, **k: [r.path.rsplit("/", 1)[-1] for r in books.find(rows, q, *a, **k).collect()]
    assert names("strfind()") == ["StrFind.html"] and names("ValueTable.Count") == ["Count.html"] and names("новый ТаблицаЗначений()") == ["Empty.html"]
    assert names("CatalogManager.FindByCode") == ["FindByCode.html"] and names("Catalogs.Items.FindByCode", owners={"catalogs": ("справочникменеджер", "catalogmanager")}) == ["FindByCode.html"]
    assert names("считает строки")[0] == "Count.html" and names("Count", "свойство") == [] and names("ValueTable.") == [] and names("") == [] and names("сумма") == ["KeyWordsSum.html"]


def test_damaged_containers():
    whole = book(PAGES)
    for bad in (b"", whole[:40], whole.replace(b"\r\n", b"xx", 1), whole[:-10], b"\0" * books.LIST + block(b"")):
        with pytest.raises(books.Damaged):
            books.parse_book(bad)
    with pytest.raises(books.Damaged):
        books.brackets("{1}}")


# -- archives and files ---------------------------------------------------------------------------------------------------


def test_archives(tmp_path):
    target = tmp_path / "dump"
    (target / "old").mkdir(parents=True)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/Configuration.xml", "<x/>")
    assert archives.unpack(str(tmp_path / "a.zip"), str(target)) == 1 and [p.name for p in target.rglob("*")] == ["x", "Configuration.xml"]
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("../evil", "x")
    with tarfile.open(tmp_path / "c.tar", "w") as t:
        link = tarfile.TarInfo("l")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc"
        t.addfile(link)
    (tmp_path / "d.zip").write_bytes(b"none")
    for bad in ("b.zip", "c.tar", "d.zip"):
        with pytest.raises(archives.Refused):
            archives.unpack(str(tmp_path / bad), str(target))
    with pytest.raises(archives.Refused):
        archives.unpack(str(tmp_path / "a.zip"), str(target), max_bytes=1)
    assert (target / "x").is_dir() and not [p for p in tmp_path.iterdir() if p.name.startswith(".dump")]


def test_json_files(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"entries": [{"id": "1", "target": "A", "target_kind": "object", "terms": ["x"]}, {"id": "2", "target": "B"}]}))
    rows = archives.read_glossary(spark, str(tmp_path / "g.json"))
    assert {r.target: (r.terms, r.note) for r in rows.collect()} == {"A": (["x"], ""), "B": ([], "")}
    archives.write_glossary(rows, str(tmp_path / "out"))
    archives.write_glossary(archives.read_glossary(spark, str(tmp_path / "out")).persist(), str(tmp_path / "out"))
    assert archives.read_glossary(spark, str(tmp_path / "out")).count() == 2
    (tmp_path / "r.json").write_text(json.dumps({"projects": [{"id": "p", "name": "P", "status": "ready", "sources": [{"id": "s", "label": "S", "source_type": "main", "xml_path": "x"}]}, {"id": "q"}]}))
    assert {(r.project_id, r.source_id) for r in archives.read_registry(spark, str(tmp_path / "r.json")).collect()} == {("p", "s"), ("q", None)}
    (tmp_path / "c.json").write_text(json.dumps([{"query": "a", "kind": "exact", "expect": ["m.p"]}, {"query": "b", "kind": "negative"}]))
    assert {r.query: r.expect for r in archives.read_cases(spark, str(tmp_path / "c.json")).collect()} == {"a": ["m.p"], "b": []}
