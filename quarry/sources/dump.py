"""Configuration dumps as tables: configuration, objects with their parts, forms, report queries, help.

``parsed`` reads every XML and help file of a dump once, in one pass of tasks over groups of files, and gives a row for
each; the tables are columns of those rows. A file that can't be read is a row with ``error`` and nothing else, so one
bad file loses nothing but itself.
"""

from __future__ import annotations

import html
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.sources.modules import relative_files

# Folders of a dump, the kinds of their objects in Russian and in English.
KINDS = """
Catalogs Справочник Catalog
Documents Документ Document
InformationRegisters РегистрСведений InformationRegister
AccumulationRegisters РегистрНакопления AccumulationRegister
AccountingRegisters РегистрБухгалтерии AccountingRegister
CalculationRegisters РегистрРасчета CalculationRegister
Enums Перечисление Enum
Reports Отчет Report
DataProcessors Обработка DataProcessor
CommonModules ОбщийМодуль CommonModule
CommonForms ОбщаяФорма CommonForm
Subsystems Подсистема Subsystem
DefinedTypes ОпределяемыйТип DefinedType
CommonPictures ОбщаяКартинка CommonPicture
SessionParameters ПараметрСеанса SessionParameter
CommonCommands ОбщаяКоманда CommonCommand
CommonAttributes ОбщийРеквизит CommonAttribute
Roles Роль Role
Styles Стиль Style
CommandGroups ГруппаКоманд CommandGroup
Languages Язык Language
Constants Константа Constant
FilterCriteria КритерийОтбора FilterCriterion
ChartsOfCharacteristicTypes ПланВидовХарактеристик ChartOfCharacteristicTypes
ChartsOfAccounts ПланСчетов ChartOfAccounts
ChartsOfCalculationTypes ПланВидовРасчета ChartOfCalculationTypes
BusinessProcesses БизнесПроцесс BusinessProcess
Tasks Задача Task
DocumentJournals ЖурналДокументов DocumentJournal
ExternalDataSources ВнешнийИсточникДанных ExternalDataSource
FunctionalOptions ФункциональнаяОпция FunctionalOption
FunctionalOptionsParameters ПараметрФункциональнойОпции FunctionalOptionsParameter
SettingsStorages ХранилищеНастроек SettingsStorage
ScheduledJobs РегламентноеЗадание ScheduledJob
EventSubscriptions ПодпискаНаСобытие EventSubscription
Interfaces Интерфейс Interface
ExchangePlans ПланОбмена ExchangePlan
HTTPServices HTTPСервис HTTPService
WebServices WebСервис WebService
CommonTemplates ОбщийМакет CommonTemplate
""".split()
FOLDERS = KINDS[::3]
RUSSIAN = dict(zip(KINDS[2::3], KINDS[1::3], strict=True))
FOLDER_KIND = dict(zip(FOLDERS, KINDS[2::3], strict=True))
# Kinds that are only referred to.
REFERRED = {
    "FunctionalOptionsParameter": "ПараметрФункциональныхОпций", "XDTOPackage": "ПакетXDTO", "StyleItem": "ЭлементСтиля", "IntegrationService": "СервисИнтеграции", "Sequence": "Последовательность",
    "WSReference": "WSСсылка", "DocumentNumerator": "НумераторДокументов", "Bot": "Бот", "WebSocketClient": "WebSocketКлиент", "PaletteColor": "ЦветПалитры",
}
# Parts of the names of types.
TYPE_KINDS = {
    "ChartOfCharacteristicTypes": "ПланВидовХарактеристик", "ChartOfCalculationTypes": "ПланВидовРасчета", "ChartOfAccounts": "ПланСчетов", "ExchangePlan": "ПланОбмена", "BusinessProcess": "БизнесПроцесс",
    "InformationRegister": "РегистрСведений", "AccumulationRegister": "РегистрНакопления", "AccountingRegister": "РегистрБухгалтерии", "CalculationRegister": "РегистрРасчета", "DocumentJournal": "ЖурналДокументов",
    "DataProcessor": "Обработка", "Catalog": "Справочник", "Document": "Документ", "Enum": "Перечисление", "Task": "Задача", "Constant": "Константа", "Report": "Отчет", "Sequence": "Последовательность", "Recalculation": "Перерасчет",
}
TYPE_ENDINGS = {
    "Ref": "Ссылка", "Object": "Объект", "Manager": "Менеджер", "Selection": "Выборка", "List": "Список", "RecordSet": "НаборЗаписей", "RecordManager": "МенеджерЗаписи",
    "RecordKey": "КлючЗаписи", "ValueManager": "МенеджерЗначения",
}
TYPE_NAMES = {
    "DefinedType": "ОпределяемыйТип", "Characteristic": "Характеристика", "AnyRef": "ЛюбаяСсылка", "AnyIBRef": "ЛюбаяСсылка", "BusinessProcessRoutePointRef": "ТочкаМаршрутаБизнесПроцессаСсылка",
    "ConstantsSet": "НаборКонстант", "ReportBuilder": "ПостроительОтчета", "ValueStorage": "ХранилищеЗначения", "UUID": "УникальныйИдентификатор", "FixedStructure": "ФиксированнаяСтруктура",
    "FixedMap": "ФиксированноеСоответствие", "FixedArray": "ФиксированныйМассив", "ValueListType": "СписокЗначений", "ValueTree": "ДеревоЗначений", "ValueTable": "ТаблицаЗначений",
    "StandardPeriod": "СтандартныйПериод", "StandardBeginningDate": "СтандартнаяДатаНачала", "SpreadsheetDocument": "ТабличныйДокумент",
    "DataCompositionSettingsComposer": "КомпоновщикНастроекКомпоновкиДанных", "Null": "Null",
}
TYPE_NAMES_ENGLISH = {"ValueListType": "ValueList", "AnyIBRef": "AnyRef"}
# Plain types in Russian and English, and words of their qualifiers.
PLAIN = {"xs:string": ("Строка", "String"), "xs:decimal": ("Число", "Number"), "xs:dateTime": ("Дата", "Date"), "xs:boolean": ("Булево", "Boolean"), "xs:base64Binary": ("ДвоичныеДанные", "BinaryData")}
WORDS = {
    "Variable": "Переменная", "Fixed": "Фиксированная", "Nonnegative": "Неотрицательный", "Date": "Дата", "DateTime": "ДатаВремя", "Time": "Время",
    "ShowError": "ВыдаватьОшибку", "DontCheck": "НеПроверять", "ForItem": "ДляЭлемента", "ForFolder": "ДляГруппы", "ForFolderAndItem": "ДляГруппыИЭлемента",
    "DontUse": "НеИспользовать", "DuringRequest": "НаВремяВызова", "DuringSession": "НаВремяСеанса", "DontIndex": "НеИндексировать", "Index": "Индексировать", "IndexWithAdditionalOrder": "ИндексироватьСДопУпорядочиванием",
}
# Properties that are kept, by kind.
REGISTERS = ("AccumulationRegister", "InformationRegister", "AccountingRegister", "CalculationRegister")
PROPERTIES = {
    **dict.fromkeys(REGISTERS, ("RegisterType", "InformationRegisterPeriodicity", "WriteMode", "ChartOfAccounts", "Correspondence")),
    "Catalog": ("CodeLength", "CodeType", "DescriptionLength", "Hierarchical", "HierarchyType"),
    "Document": ("NumberLength", "NumberType", "Posting"),
    "ChartOfCharacteristicTypes": ("CodeLength", "DescriptionLength", "Hierarchical"),
    "ChartOfAccounts": ("CodeLength", "DescriptionLength", "OrderLength", "MaxExtDimensionCount", "ExtDimensionTypes"),
    "ChartOfCalculationTypes": ("CodeLength", "CodeType", "DescriptionLength", "DependenceOnCalculationTypes", "ActionPeriodUse"),
    "ExchangePlan": ("CodeLength", "DescriptionLength"),
    "BusinessProcess": ("NumberLength", "NumberType"),
    "Task": ("NumberLength", "NumberType", "DescriptionLength"),
}
MODULE_FLAGS = ("Global", "ClientManagedApplication", "Server", "ExternalConnection", "ServerCall", "Privileged")
ATTRIBUTES = {"Attribute": "Реквизит", "Dimension": "Измерение", "Resource": "Ресурс"}
TYPED = ("DefinedType", "SessionParameter", "Constant")
SECTION, VALUE = "Табличная часть", "Значение перечисления"
#: Characters of a help text and of a report's query that are kept, as the format has it.
HELP_CHARS, QUERY_CHARS = 20_000, 60_000

_UUID = re.compile(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I)

ATTRIBUTE = "name string, kind string, section string, type_desc string, synonym string, comment string, is_indexed boolean, check_fill string, use string"
PARSED = (
    "relative_path string, part string, owner string, full_name string, kind string, name string, synonym string, comment string, version string, compatibility string, english boolean, type_desc string, "
    f"children array<struct<kind:string,name:string>>, attributes array<struct<{ATTRIBUTE.replace(' ', ':').replace(',:', ',')}>>, forms array<string>, properties array<struct<key:string,value:string>>, "
    "content array<string>, events array<struct<element:string,event:string,handler:string,call_type:string>>, queries array<struct<dataset:string,query:string>>, text string, error string"
)
_COLUMNS = [c.split(" ")[0] for c in re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", PARSED)).split(", ")]


# -- elements ------------------------------------------------------------------------------------------------------------


def _tag(el: ET.Element) -> str:
    return el.tag.rsplit("}", 1)[-1]


def _all(el: ET.Element | None, name: str) -> list[ET.Element]:
    return [c for c in el if _tag(c) == name] if el is not None else []


def _one(el: ET.Element | None, name: str) -> ET.Element | None:
    return next(iter(_all(el, name)), None)


def _text(el: ET.Element | None, name: str) -> str:
    found = _one(el, name)
    return (found.text or "").strip() if found is not None else ""


def localized(el: ET.Element | None) -> str:
    """A string in several languages: the Russian one, else the first."""
    items = [(_text(i, "lang"), _text(i, "content")) for i in _all(el, "item")]
    return next((content for lang, content in items if lang == "ru"), items[0][1] if items else "")


def word(value: str, english: bool) -> str:
    return value if english else WORDS.get(value, value)


def type_name(raw: str, english: bool) -> str:
    """cfg:CatalogRef.X as the dump's language writes it."""
    head, dot, rest = raw.split(":", 1)[-1].partition(".")
    if english:
        return TYPE_NAMES_ENGLISH.get(head, head) + dot + rest
    made = next((ru + TYPE_ENDINGS[head[len(en) :]] for en, ru in TYPE_KINDS.items() if head.startswith(en) and head[len(en) :] in TYPE_ENDINGS), head)
    return TYPE_NAMES.get(head, made) + dot + rest


def type_text(el: ET.Element | None, english: bool) -> str:
    """A type with its qualifiers; the parts of a composite one are parted by commas."""

    def qualified(raw: str) -> str:
        if raw not in PLAIN:
            return type_name(raw, english)
        inside = []
        if raw == "xs:string":
            q = _one(el, "StringQualifiers")
            inside = [_text(q, "Length") or "0", "Fixed" if _text(q, "AllowedLength") == "Fixed" else "Variable"]
        elif raw == "xs:decimal":
            q = _one(el, "NumberQualifiers")
            inside = [_text(q, "Digits") or "0", _text(q, "FractionDigits") or "0"] + (["Nonnegative"] if _text(q, "AllowedSign") == "Nonnegative" else [])
        elif raw == "xs:dateTime":
            inside = [_text(_one(el, "DateQualifiers"), "DateFractions") or "DateTime"]
        name = PLAIN[raw][english]
        return f"{name}({', '.join(word(x, english) for x in inside)})" if inside else name

    parts = [(t.text or "").strip() for t in el if _tag(t) in ("Type", "TypeSet")] if el is not None else []
    return ", ".join(qualified(p) for p in parts if p)


def _references(el: ET.Element | None, russian: bool) -> list[str]:
    """Kind.Name of the items; those of other configurations, written as ids, are left out."""
    out = []
    for item in _all(el, "Item"):
        text = (item.text or "").strip()
        if text and not _UUID.fullmatch(text):
            head, dot, rest = text.partition(".")
            out.append((REFERRED.get(head, RUSSIAN.get(head, head)) if russian else head) + dot + rest)
    return out


def _attribute(el: ET.Element, kind: str, section: str, english: bool) -> dict:
    p = _one(el, "Properties")
    indexing = _text(p, "Indexing")
    return {
        "name": _text(p, "Name"), "kind": kind, "section": section, "type_desc": type_text(_one(p, "Type"), english), "synonym": localized(_one(p, "Synonym")), "comment": _text(p, "Comment"),
        "is_indexed": indexing not in ("", "DontIndex"), "check_fill": word(_text(p, "FillChecking"), english), "use": word(_text(p, "Use"), english),
    }


# -- files ---------------------------------------------------------------------------------------------------------------


def parse_object(root: ET.Element, english: bool) -> dict:
    """The fields of an object's file, whatever its kind."""
    el = next(iter(root))
    kind, p = _tag(el), _one(el, "Properties")
    out: dict = {"kind": kind, "name": _text(p, "Name"), "synonym": localized(_one(p, "Synonym")), "comment": _text(p, "Comment"), "attributes": [], "forms": [], "children": []}
    kept = {x: _text(p, x) for x in PROPERTIES.get(kind, ())}
    if kind == "CommonModule":
        kept |= {f: _text(p, f) for f in MODULE_FLAGS} | {"ReturnValuesReuse": word(_text(p, "ReturnValuesReuse"), english)}
    rows = [(k, v) for k, v in kept.items() if v]
    if kind == "Subsystem":
        out["content"] = _references(_one(p, "Content"), not english)
    elif kind == "Document":
        rows += [("RegisterRecords", r) for r in _references(_one(p, "RegisterRecords"), True)]
    elif kind == "Catalog":
        rows += [("Owners", r) for r in _references(_one(p, "Owners"), True)]
    elif kind in TYPED:
        out["type_desc"] = type_text(_one(p, "Type"), english)
    elif kind == "Template":
        rows.append(("TemplateType", _text(p, "TemplateType")))
    for child in _one(el, "ChildObjects") if _one(el, "ChildObjects") is not None else ():
        tag, inner = _tag(child), _one(child, "Properties")
        if tag in ATTRIBUTES:
            out["attributes"].append(_attribute(child, ATTRIBUTES[tag], "", english))
        elif tag == "TabularSection":
            section = _text(inner, "Name")
            out["attributes"].append(_attribute(child, SECTION, "", english))
            out["attributes"] += [_attribute(a, ATTRIBUTES["Attribute"], section, english) for a in _all(_one(child, "ChildObjects"), "Attribute")]
        elif tag == "EnumValue":
            out["attributes"].append(_attribute(child, VALUE, "", english))
        elif tag == "Form":
            out["forms"].append((child.text or "").strip())
        if (child.text or "").strip():
            out["children"].append({"kind": tag, "name": child.text.strip()})
    out["properties"] = [{"key": k, "value": v} for k, v in rows]
    return out


def parse_configuration(root: ET.Element) -> dict:
    el = next(iter(root))
    p = _one(el, "Properties")
    children = [{"kind": _tag(c), "name": (c.text or "").strip()} for c in (_one(el, "ChildObjects") if _one(el, "ChildObjects") is not None else ())]
    return {
        "kind": "Configuration", "name": _text(p, "Name"), "synonym": localized(_one(p, "Synonym")), "comment": _text(p, "Comment"), "version": _text(p, "Version"), "compatibility": _text(p, "CompatibilityMode"),
        "english": _text(p, "ScriptVariant") == "English", "children": [c for c in children if c["name"]],
    }


def parse_form(root: ET.Element, english: bool) -> dict:
    """Attributes of a form and of the form it was borrowed from (the first of a name counts), and its events."""
    attributes: dict[str, dict] = {}
    for holder in [root, *_all(root, "BaseForm")]:
        for el in (a for group in _all(holder, "Attributes") for a in _all(group, "Attribute")):
            name = el.get("name") or ""
            if name:
                attributes.setdefault(name.lower(), {"name": name, "kind": "РеквизитФормы", "section": "", "type_desc": type_text(_one(el, "Type"), english), "synonym": localized(_one(el, "Title"))})
    events: dict[tuple[str, str], dict] = {}
    waiting = [(root, "")]
    while waiting:
        holder, owner = waiting.pop()
        for el in holder:
            if _tag(el) != "Events":
                waiting.append((el, el.get("name") or owner))
                continue
            for e in _all(el, "Event"):
                name, handler = e.get("name") or "", (e.text or "").strip()
                if name and handler:
                    events[owner, name] = {"element": owner, "event": name, "handler": handler, "call_type": (e.get("callType") or "").strip()}
    return {"attributes": list(attributes.values()), "events": [events[k] for k in sorted(events)]}


def parse_schema(root: ET.Element) -> dict:
    """The queries of a data composition schema: of every data set that has one, those inside unions too."""
    found = [(_text(el, "name"), (_one(el, "query").text or "").strip()) for el in root.iter() if _tag(el) in ("dataSet", "item") and _one(el, "query") is not None]
    return {"queries": [{"dataset": n, "query": q[:QUERY_CHARS]} for n, q in found if q]}


class _Visible(HTMLParser):
    BLOCKS = frozenset("p div br li tr h1 h2 h3 h4 h5 h6 table ul ol".split())
    HIDDEN = frozenset("script style head".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in self.HIDDEN
        self.parts.append("\n" if tag in self.BLOCKS else "")

    def handle_endtag(self, tag: str) -> None:
        self.hidden = max(0, self.hidden - (tag in self.HIDDEN))
        self.parts.append("\n" if tag in self.BLOCKS else "")

    def handle_data(self, data: str) -> None:
        self.parts.append("" if self.hidden else data)


def visible_text(markup: str, limit: int = HELP_CHARS) -> str:
    """The text of a page as a reader sees it: entities resolved, blocks as lines, no scripts, styles or head."""
    page = _Visible()
    try:
        page.feed(markup)
        page.close()
        text = "".join(page.parts)
    except (ValueError, AssertionError):
        text = html.unescape(re.sub(r"<[^>]+>", " ", markup))
    lines = (re.sub("[ \t\xa0﻿]+", " ", line).strip() for line in text.split("\n"))
    return "\n".join(line for line in lines if line)[:limit]


def part_of(path: str) -> tuple[str, str]:
    """(part, owner) of a file by its place: configuration, object, form, template, schema or help; the owner's full path."""
    steps = path.split("/")
    if path == "Configuration.xml":
        return "configuration", ""
    if steps[-1] == "Form.xml" and steps[-2:-1] == ["Ext"]:
        return "form", "/".join(steps[:-2])
    if steps[-1] == "Template.xml" and steps[-2:-1] == ["Ext"]:
        return "schema", "/".join(steps[:-2])
    if steps[-1].lower().endswith(".html") and steps[-3:-1] == ["Ext", "Help"]:
        return "help", "/".join(steps[:-3])
    if len(steps) > 2 and steps[-2] == "Templates" and path.endswith(".xml"):
        return "template", "/".join(steps[:-2])
    if path.endswith(".xml") and (len(steps) == 2 and steps[0] in FOLDERS or len(steps) % 2 == 0 and steps[0] == "Subsystems" and set(steps[::2]) == {"Subsystems"}):
        return "object", ""
    return "other", ""


def full_name(path: str, kind: str, english: bool) -> str:
    """The full name of an object by its file's path: Kind.Name, nested subsystems by the path of their parents."""
    names = path.removesuffix(".xml").split("/")[1::2]
    between = ".Subsystems." if english else ".Подсистемы."
    return f"{RUSSIAN.get(kind, kind)}.{between.join(names)}"


def parse_file(path: str, content: bytes, english: bool) -> dict | None:
    part, owner = part_of(path)
    out = {"relative_path": path, "part": part, "owner": owner}
    if part == "other":
        return None
    try:
        if part == "help":
            return out | {"name": path.rsplit("/", 1)[-1].rsplit(".", 1)[0], "text": visible_text(content.decode("utf-8-sig", "replace"))}
        root = ET.fromstring(content)
        if part == "configuration":
            return out | parse_configuration(root)
        if part == "form":
            return out | parse_form(root, english)
        if part == "schema":
            return out | parse_schema(root)
        found = parse_object(root, english)
        return out | found | ({"full_name": full_name(path, found["kind"], english)} if part == "object" else {})
    except (ET.ParseError, StopIteration) as e:
        return out | {"error": str(e) or "no element"}


# -- tables --------------------------------------------------------------------------------------------------------------


def probe(spark: SparkSession, root: str) -> DataFrame:
    """has_configuration, english, compatibility (a number, or empty): one row, from the configuration's own file."""
    rows = [r for r in relative_files(spark, root, "Configuration.xml").filter("relative_path = 'Configuration.xml'").select("content").limit(1).collect()]
    found: dict = parse_file("Configuration.xml", bytes(rows[0].content), False) or {} if rows else {}
    mode = re.fullmatch(r"Version(\d+(?:_\d+)+)", found.get("compatibility") or "")
    return spark.createDataFrame([(bool(rows), bool(found.get("english")), mode[1].replace("_", ".") if mode else "")], "has_configuration boolean, english boolean, compatibility string")


def parsed(spark: SparkSession, root: str) -> DataFrame:
    """A row for each file of the dump that says something: the columns of PARSED. Write it once, then take the tables."""
    english = probe(spark, root).first().english
    files = relative_files(spark, root, "*.{xml,html,htm}").select("relative_path", "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):  # one file at a time: they may be large
                found = parse_file(batch.column(0)[at].as_py(), batch.column(1)[at].as_py(), english)
                if found:
                    yield pa.RecordBatch.from_pylist([found | {c: found.get(c) for c in _COLUMNS}], schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(PARSED))
    return files.mapInArrow(parse, PARSED)


def objects(files: DataFrame) -> DataFrame:
    """object, kind, name, synonym, comment, type_desc, help of the objects that the configuration lists, and of their subsystems.

    A listed object without a readable file is left out. Help is the Russian page, else the first by name.
    """
    listed = files.filter("part = 'configuration'").select(F.explode("children").alias("c")).select(_folder(F.col("c.kind")).alias("folder"), F.col("c.name").alias("name"))
    rows = files.filter("part = 'object' and error is null").withColumn("steps", F.split("relative_path", "/"))
    top = rows.withColumn("folder", F.get("steps", F.lit(0))).withColumn("top", F.regexp_replace(F.get("steps", F.lit(1)), r"\.xml$", ""))
    kept = top.join(listed.select("folder", F.col("name").alias("top")).distinct(), ["folder", "top"], "left_semi")
    page = F.min_by("text", F.struct(F.col("name") != "ru", "relative_path"))
    helps = files.filter("part = 'help'").groupBy("owner").agg(page.alias("help"))
    kept = kept.withColumn("owner", F.regexp_replace("relative_path", r"\.xml$", "")).join(helps, "owner", "left")
    kind = F.coalesce(F.create_map(*[F.lit(x) for pair in RUSSIAN.items() for x in pair])[F.col("kind")], "kind")
    return kept.select(F.col("full_name").alias("object"), kind.alias("kind"), "name", "synonym", "comment", F.coalesce("type_desc", F.lit("")).alias("type_desc"), F.coalesce("help", F.lit("")).alias("help"))


def _folder(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for folder, en in FOLDER_KIND.items() for x in (en, folder)])[kind]


def _of_objects(files: DataFrame) -> DataFrame:
    return files.filter("part = 'object' and error is null").withColumnRenamed("full_name", "object")


def attributes(files: DataFrame) -> DataFrame:
    """object, attribute (of a section: section.name), kind, type_desc, synonym, comment, is_indexed, check_fill, use."""
    rows = _of_objects(files).select("object", F.explode("attributes").alias("a"))
    name = F.when(F.col("a.section") != "", F.concat_ws(".", "a.section", "a.name")).otherwise(F.col("a.name"))
    return rows.select("object", name.alias("attribute"), "a.kind", "a.type_desc", "a.synonym", "a.comment", "a.is_indexed", "a.check_fill", "a.use")


def forms(files: DataFrame) -> DataFrame:
    return _of_objects(files).select("object", F.explode("forms").alias("form"))


def properties(files: DataFrame) -> DataFrame:
    """object, key, value: one row for each property; lists have a row for each member."""
    return _of_objects(files).select("object", F.explode("properties").alias("p")).select("object", "p.key", "p.value")


def subsystem_content(files: DataFrame) -> DataFrame:
    return _of_objects(files).select("object", F.explode("content").alias("member"))


def report_queries(files: DataFrame) -> DataFrame:
    """report, template, dataset, query: the queries of the composition schemas of reports."""
    schemas = files.filter("part = 'schema'").select(F.col("owner").alias("path"), "queries")
    is_schema = F.exists("properties", lambda p: (p["key"] == "TemplateType") & (p["value"] == "DataCompositionSchema"))
    templates = files.filter("part = 'template'").filter(is_schema).select(F.regexp_replace("relative_path", r"\.xml$", "").alias("path"), "owner", F.col("name").alias("template"))
    owners = _of_objects(files).filter("kind = 'Report'").select(F.regexp_replace("relative_path", r"\.xml$", "").alias("owner"), F.col("object").alias("report"))
    rows = templates.join(owners, "owner").join(schemas, "path").select("report", "template", F.explode("queries").alias("q"))
    return rows.select("report", "template", "q.dataset", "q.query")


def form_attributes(files: DataFrame) -> DataFrame:
    """owner (the form's path), attribute, title, type_desc."""
    rows = files.filter("part = 'form'").select("owner", F.explode("attributes").alias("a"))
    return rows.select("owner", F.col("a.name").alias("attribute"), F.col("a.synonym").alias("title"), "a.type_desc")


def form_events(files: DataFrame) -> DataFrame:
    """owner (the form's path), element, event, handler, call_type."""
    return files.filter("part = 'form'").select("owner", F.explode("events").alias("e")).select("owner", "e.*")


def event_intercepts(extension: DataFrame, main: DataFrame, english: bool = False) -> DataFrame:
    """owner, procedure, ext_procedure, directive: handlers of ``form_events`` of the main dump that an extension's form
    takes over, by form, element and event."""
    words = {"before": ("Перед", "Before"), "after": ("После", "After"), "override": ("Вместо", "Around")}
    directive = F.create_map(*[F.lit(x) for k, v in words.items() for x in (k, f"&{v[english]}:")])[F.lower("call_type")]
    ours = extension.filter("call_type != ''").select("owner", "element", "event", F.col("handler").alias("ext_procedure"), directive.alias("directive"))
    theirs = main.filter("call_type = ''").select("owner", "element", "event", F.col("handler").alias("procedure"))
    return ours.filter("directive is not null").join(theirs, ["owner", "element", "event"]).select("owner", "procedure", "ext_procedure", "directive")


def known_names(files: DataFrame) -> DataFrame:
    """kind, name in lower case of all listed objects of one or more dumps (their files joined): what a call may name."""
    return objects(files).select(F.lower("kind").alias("kind"), F.lower("name").alias("name")).distinct()


def in_order(files: DataFrame) -> DataFrame:
    """place, kind, name: the children of the configuration in the order of its list."""
    rows = files.filter("part = 'configuration'").select(F.posexplode("children").alias("place", "c")).select("place", "c.kind", "c.name")
    return rows.withColumn("place", F.row_number().over(Window.orderBy("place")))
