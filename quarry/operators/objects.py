"""Pages of objects: their parts, standard attributes, hints for queries, references, reports and registers.

Tables of ``quarry.sources.dump`` with a source_id where several sources are joined: ``objects``, ``attributes``, ``forms``,
``properties``, ``content`` (object, member), ``queries`` (report, dataset, query).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import query_references, type_targets

#: Attributes that a brief page shows.
BRIEF = 30
# Properties in a dump and in the index, and their values.
KEYS = {
    "RegisterType": "ВидРегистра", "InformationRegisterPeriodicity": "Периодичность", "WriteMode": "РежимЗаписи", "ChartOfAccounts": "ПланСчетов", "Correspondence": "Корреспонденция", "RegisterRecords": "Движения",
    "CodeLength": "ДлинаКода", "CodeType": "ТипКода", "DescriptionLength": "ДлинаНаименования", "Hierarchical": "Иерархический", "HierarchyType": "ВидИерархии", "Owners": "Владелец", "NumberLength": "ДлинаНомера",
    "NumberType": "ТипНомера", "Posting": "Проведение", "OrderLength": "ДлинаПорядка", "MaxExtDimensionCount": "КоличествоСубконто", "ExtDimensionTypes": "ВидыСубконто",
    "DependenceOnCalculationTypes": "ЗависимостьОтВидовРасчета", "ActionPeriodUse": "ПериодДействия",
}
VALUES = {
    "Balance": "Остатки", "Turnovers": "Обороты", "Nonperiodical": "Непериодический", "Second": "Секунда", "Day": "День", "Month": "Месяц", "Quarter": "Квартал", "Year": "Год",
    "RecorderPosition": "ПозицияРегистратора", "Independent": "Независимый", "RecorderSubordinate": "ПодчинениеРегистратору", "true": "Да", "false": "Нет", "String": "Строка", "Number": "Число",
    "HierarchyFoldersAndItems": "ГруппыИЭлементы", "HierarchyOfItems": "Элементы", "Allow": "Разрешить", "Deny": "Запретить", "DontUse": "НеИспользовать",
    "OnActionPeriod": "ПоПериодуДействия", "OnRegistrationPeriod": "ПоПериодуРегистрации",
}
PREFIXES = {"ChartOfAccounts.": "ПланСчетов.", "ChartOfCharacteristicTypes.": "ПланВидовХарактеристик."}
REGISTERS = ("РегистрНакопления", "РегистрСведений", "РегистрБухгалтерии", "РегистрРасчета")


def _word(values: dict[str, str], key: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key], key)


def normal_properties(properties: DataFrame) -> DataFrame:
    """``properties`` (object, key, value) with keys and values as the index has them; other keys are left out."""
    value = F.trim("value")
    value = reduce(lambda c, p: F.when(value.startswith(p[0]), F.concat(F.lit(p[1]), F.substring(value, F.lit(len(p[0]) + 1), F.length(value)))).otherwise(c), PREFIXES.items(), _word(VALUES, value))
    return properties.filter(F.col("key").isin(*KEYS) & (F.trim("value") != "")).withColumns({"value": value, "key": _word(KEYS, F.col("key"))})


def property_maps(normal: DataFrame) -> DataFrame:
    """object, props: a map from each key to its values in order."""
    lists = normal.groupBy("object", "key").agg(F.array_sort(F.collect_list("value")).alias("values"))
    return lists.groupBy("object").agg(F.map_from_entries(F.collect_list(F.struct("key", "values"))).alias("props"))


# -- hints ----------------------------------------------------------------------------------------------------------------


def _first(key: str) -> Column:
    return F.get(F.col("props")[key], F.lit(0))


def resource_fields(resources: Column, *suffixes: str) -> Column:
    """The fields of a virtual table: each suffix on the first three resources; dots where there are more."""
    some = F.slice(resources, 1, 3)
    ended = lambda s: F.transform(some, lambda r: F.concat(r, F.lit(s)))
    names = F.flatten(F.array(*[ended(s) for s in suffixes]))
    listed = F.concat(F.array_join(names, ", "), F.when(F.size(resources) > 3, ", …").otherwise(""))
    return F.when(F.size(resources) > 0, listed).otherwise(", ".join(f"<Ресурс>{s}" for s in suffixes))


def query_hints(registers: DataFrame) -> DataFrame:
    """``registers`` (object, kind, props, resources: array) with ``hints``: how a query reads each of them.

    The wording and the names of tables and fields are fixed values of the query language and of the index.
    """
    name = F.col("object")
    table = lambda suffix: F.concat(name, F.lit(suffix))
    r = F.col("resources")
    balance = F.array(
        F.lit("Вид регистра: остатки"),
        F.concat(F.lit("В запросе: "), table(".Остатки(&Период, Условие) — "), resource_fields(r, "Остаток"), F.lit("; .Обороты(&Начало, &Конец, Периодичность, Условие) — "), resource_fields(r, "Приход", "Расход"), F.lit("; .ОстаткиИОбороты(...); движения — "), name),
    )
    turnover = F.array(F.lit("Вид регистра: обороты"), F.concat(F.lit("В запросе: "), table(".Обороты(&Начало, &Конец, Периодичность, Условие) — "), resource_fields(r, "Оборот"), F.lit("; движения — "), name))
    mode = F.when(_first("РежимЗаписи") == "ПодчинениеРегистратору", "; запись: подчинён регистратору").when(_first("РежимЗаписи") == "Независимый", "; запись: независимый").otherwise("")
    period = _first("Периодичность")
    slice_ = F.when(period == "Непериодический", F.concat(F.lit("В запросе: "), name, F.lit(" — сама таблица, без среза по дате"))).otherwise(
        F.concat(F.lit("В запросе: "), table(".СрезПоследних(&Период, Условие) — значения на дату; .СрезПервых(...); вся история — "), name, F.lit(" (поле Период)"))
    )
    information = F.array(F.concat(F.lit("Периодичность: "), period, mode), slice_)
    head = F.concat_ws("; ", F.concat(F.lit("План счетов: "), _first("ПланСчетов")), F.when(_first("Корреспонденция") == "Да", "с корреспонденцией"))
    accounts = F.concat(
        F.lit("В запросе: "), table(".Остатки(&Период, СчетУсловие, Субконто, Условие) — "), resource_fields(r, "ОстатокДт", "ОстатокКт"),
        F.lit("; .Обороты(&Начало, &Конец, Периодичность, СчетУсловие, Субконто, Условие, КорСчетУсловие, КорСубконто); .ОстаткиИОбороты(...); .ДвиженияССубконто(...)"),
    )
    accounting = F.filter(F.array(head, accounts), lambda x: x != "")
    kind, type_ = F.col("kind"), _first("ВидРегистра")
    hints = (
        F.when((kind == "РегистрНакопления") & (type_ == "Остатки"), balance)
        .when((kind == "РегистрНакопления") & type_.isNotNull(), turnover)
        .when((kind == "РегистрСведений") & period.isNotNull(), information)
        .when(kind == "РегистрБухгалтерии", accounting)
        .otherwise(F.array().cast("array<string>"))
    )
    return registers.withColumn("hints", hints)


def standard_attributes(rows: DataFrame) -> DataFrame:
    """``rows`` (object, kind, props) with ``fields`` and ``absent``: the standard attributes that an object has, and those
    of its kin that it lacks. Null where the kind has none or nothing is known of them."""
    number = lambda key: F.coalesce(_first(key).try_cast("int"), F.lit(0))
    has = lambda c, *names: F.when(c, F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>"))
    always = lambda *names: F.array(*map(F.lit, names))
    sized = lambda name, key, type_: F.when(number(key) > 0, F.array(F.concat(F.lit(f"{name} ("), type_, F.lit(" "), number(key).cast("string"), F.lit(")")))).otherwise(F.array().cast("array<string>"))
    code = sized("Код", "ДлинаКода", F.coalesce(_first("ТипКода"), F.lit("Строка")))
    title = sized("Наименование", "ДлинаНаименования", F.lit("Строка"))
    numbered = sized("Номер", "ДлинаНомера", F.coalesce(_first("ТипНомера"), F.lit("Строка")))
    tree, of_items = _first("Иерархический") == "Да", _first("ВидИерархии") == "Элементы"
    tree, of_items = F.coalesce(tree, F.lit(False)), F.coalesce(of_items, F.lit(False))
    owners = F.col("props")["Владелец"]
    posted = F.coalesce(_first("Проведение"), F.lit("Разрешить")) == "Разрешить"
    period = F.coalesce(_first("ПериодДействия") == "Да", F.lit(False))
    predefined = always("Предопределенный", "ИмяПредопределенныхДанных")
    base = always("Ссылка", "ПометкаУдаления")
    fields = {
        "Справочник": [code, title, has(tree, "Родитель"), has(tree & ~of_items, "ЭтоГруппа"), F.when(F.size(owners) > 0, F.array(F.concat(F.lit("Владелец ("), F.array_join(owners, " или "), F.lit(")")))).otherwise(F.array().cast("array<string>")), predefined],
        "ПланВидовХарактеристик": [code, title, always("ТипЗначения"), has(tree, "Родитель", "ЭтоГруппа"), predefined],
        "ПланСчетов": [code, title, always("Родитель"), has(number("ДлинаПорядка") > 0, "Порядок"), always("Вид", "Забалансовый"), predefined],
        "ПланВидовРасчета": [code, title, has(period, "ПериодДействияБазовый"), predefined],
        "ПланОбмена": [code, title, always("НомерОтправленного", "НомерПринятого", "ЭтотУзел")],
        "Документ": [always("Дата"), numbered, has(posted, "Проведен"), always("МоментВремени")],
        "БизнесПроцесс": [always("Дата"), numbered, always("ВедущаяЗадача", "Стартован", "Завершен")],
        "Задача": [always("Дата"), numbered, title, always("Выполнена", "БизнесПроцесс", "ТочкаМаршрута")],
    }
    no_code, no_title, no_number = has(number("ДлинаКода") == 0, "Код"), has(number("ДлинаНаименования") == 0, "Наименование"), has(number("ДлинаНомера") == 0, "Номер")
    absent = {
        "Справочник": [no_code, no_title, has(tree & of_items, "ЭтоГруппа"), has(~tree, "Родитель", "ЭтоГруппа"), has(F.coalesce(F.size(owners), F.lit(0)) <= 0, "Владелец")],
        "ПланВидовХарактеристик": [no_code, no_title, has(~tree, "Родитель", "ЭтоГруппа")],
        "ПланСчетов": [no_code, no_title, always("ЭтоГруппа")],
        "ПланВидовРасчета": [no_code, no_title],
        "ПланОбмена": [no_code, no_title],
        "Документ": [no_number, has(~posted, "Проведен"), always("Код", "Наименование")],
        "БизнесПроцесс": [no_number],
        "Задача": [no_number, no_title],
    }
    known = F.exists(F.array(*map(F.lit, ("ДлинаКода", "ДлинаНаименования", "ДлинаНомера", "Проведение"))), lambda k: F.map_contains_key("props", k))
    by_kind = lambda parts, first: reduce(lambda c, x: c.when((F.col("kind") == x[0]) & known, F.concat(*first, *x[1])), parts.items(), F.when(F.lit(False), base))
    return rows.withColumns({"fields": by_kind(fields, [base]), "absent": by_kind(absent, [])})


# -- pages ----------------------------------------------------------------------------------------------------------------


def pages(objects: DataFrame, attributes: DataFrame, forms: DataFrame, properties: DataFrame, content: DataFrame, brief: bool = True, main_source: str | None = None) -> DataFrame:
    """One row for each object (of several sources' the main one's, else the least): object, kind, synonym, comment,
    attributes, n_attributes, sections, values, forms, props, recorded_by, content, children, other_sources.

    Lists are in order of name; a brief page shows BRIEF attributes. children are the objects one name below, such as
    nested subsystems; recorded_by the documents that write a register.
    """
    key = ["object", "source_id"]
    lists = lambda frame, name, value, by=None: frame.groupBy(*key).agg(F.array_sort(F.collect_list(value)).alias(name))
    plain = ~F.col("attribute").contains(".")
    of = lambda kinds: attributes.filter(plain & F.col("kind").isin(*kinds))
    listed = of(("Реквизит", "Измерение", "Ресурс")).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("attribute", "kind", "type_desc"))).alias("attributes"))
    inner = attributes.filter(~plain).select(*key, F.substring_index("attribute", ".", 1).alias("section"), F.struct(F.substring_index("attribute", ".", -1).alias("attribute"), "type_desc").alias("a"))
    sections = inner.groupBy(*key, "section").agg(F.array_sort(F.collect_list("a")).alias("attributes")).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("section", "attributes"))).alias("sections"))
    values = lists(of(("Значение перечисления",)), "values", "attribute")
    written = normal_properties(properties)
    recorded = written.filter("key = 'Движения'").select(F.col("value").alias("object"), F.col("object").alias("document")).groupBy("object").agg(F.array_sort(F.collect_set("document")).alias("recorded_by"))
    parent = F.when(F.col("object").rlike(r"^[^.]+\.[^.]+\.[^.]+\.[^.]+"), F.regexp_replace("object", r"\.[^.]+\.[^.]+$", ""))
    children = objects.select(parent.alias("object"), F.col("object").alias("child"), "source_id").filter("object is not null").groupBy(*key).agg(F.array_sort(F.collect_set("child")).alias("children"))
    best = F.row_number().over(Window.partitionBy("object").orderBy(F.desc(F.col("source_id") == F.lit(main_source or "")), "source_id"))
    others = objects.groupBy("object").agg(F.array_sort(F.collect_set("source_id")).alias("sources"))
    rows = objects.withColumn("rn", best).filter("rn = 1").drop("rn").join(others, "object")
    for part in (listed, sections, values, lists(forms, "forms", "form"), lists(content, "content", "member"), children):
        rows = rows.join(part, key, "left")
    rows = rows.join(recorded, "object", "left").join(property_maps(written), "object", "left")
    shown = F.slice("attributes", 1, BRIEF) if brief else F.col("attributes")
    return rows.select(
        "object", "source_id", "kind", "synonym", "comment", shown.alias("attributes"), F.coalesce(F.size("attributes"), F.lit(0)).alias("n_attributes"), "sections", "values", "forms", "props", "recorded_by", "content", "children",
        F.array_remove("sources", F.col("source_id")).alias("other_sources"),
    )


def children_of(objects: DataFrame, prefix: str) -> DataFrame:
    """The objects directly below a full name: those whose rest has two words, a folder's and their own."""
    rest = F.substring(F.col("object"), F.lit(len(prefix) + 2), F.length("object"))
    return objects.filter(F.col("object").startswith(prefix + ".") & (F.size(F.split(rest, r"\.")) == 2)).orderBy("object")


# -- references -----------------------------------------------------------------------------------------------------------


def references(attributes: DataFrame, objects: DataFrame) -> DataFrame:
    """object, attribute, target: attributes whose type refers to an object, by the parsed name of the type.

    An equi-join on kind and name, so that no name is compared with every type.
    """
    rows = attributes.select("object", "attribute", F.explode(type_targets(F.col("type_desc"))).alias("t")).filter("t.target is not null")
    kind = F.regexp_replace("t.head", "(Ref|Ссылка)$", "")
    english = objects.select(F.lower("kind").alias("kind_key"), F.lower("name").alias("name_key"), F.col("object").alias("target"))
    named = rows.select("object", "attribute", F.lower(kind).alias("kind_key"), F.lower("t.target").alias("name_key"))
    return named.join(english, ["kind_key", "name_key"]).select("object", "attribute", "target").distinct()


def find_references(attributes: DataFrame, name: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """object, attribute, type_desc, exact: types that name the object, those that refer to it exactly first."""
    low = name.lower()
    short = low.rsplit(".", 1)[-1]
    exact = F.exists(type_targets(F.col("type_desc")), lambda t: F.coalesce(F.lower(t["target"]) == short, F.lit(False)))
    rows = attributes.filter(F.lower("type_desc").contains(short)).withColumn("exact", exact)
    return rows.select("object", "attribute", "type_desc", "exact").orderBy(F.desc("exact"), "object", "attribute").offset(offset).limit(limit)


def report_sources(queries: DataFrame, objects: DataFrame, include_query: bool = False) -> DataFrame:
    """report, queries, uses: the queries of each report's schemas and the objects they read that exist."""
    rows = queries.select("report", F.explode(query_references(F.col("query"))).alias("ref")).withColumn("key", F.lower("ref")).select("report", "key").distinct()
    uses = rows.join(objects.select(F.lower("object").alias("key"), "object").distinct(), "key").groupBy("report").agg(F.array_sort(F.collect_set("object")).alias("uses"))
    shown = F.struct("template", "dataset", F.length("query").alias("chars"), *(["query"] if include_query else []))
    lists = queries.groupBy("report").agg(F.array_sort(F.collect_list(shown)).alias("queries"))
    return lists.join(uses, "report", "left").withColumn("uses", F.coalesce("uses", F.array().cast("array<string>")))


def used_by(queries: DataFrame, objects: DataFrame, kinds: tuple[str, ...] = REGISTERS) -> DataFrame:
    """object, used_by: the reports whose queries read each register."""
    rows = queries.select("report", F.explode(query_references(F.col("query"))).alias("ref")).select("report", F.lower("ref").alias("key")).distinct()
    registers = objects.filter(F.col("kind").isin(*kinds)).select(F.lower("object").alias("key"), "object").distinct()
    return registers.join(rows, "key", "left").groupBy("object").agg(F.array_sort(F.collect_set("report")).alias("used_by"))


def registers_of_documents(properties: DataFrame, reports: DataFrame) -> DataFrame:
    """document, register, documents, reports: what a document writes, the registers that fewest documents write first.

    ``reports``: object, used_by, of ``used_by``. The fewer documents share a register, the more it tells of one.
    """
    rows = normal_properties(properties).filter("key = 'Движения'").select(F.col("object").alias("document"), F.col("value").alias("register")).distinct()
    shared = rows.groupBy("register").agg(F.count(F.lit(1)).alias("documents"))
    counted = reports.select(F.col("object").alias("register"), F.size("used_by").alias("reports"))
    return rows.join(shared, "register").join(counted, "register", "left").select("document", "register", "documents", F.coalesce("reports", F.lit(0)).alias("reports")).orderBy("document", "documents", "register")


def reference_graph(edges: DataFrame, roots: DataFrame, depth: int = 2, per_node: int = 100) -> DataFrame:
    """source, target, depth: references from objects to those that refer to them, level by level; at most ``per_node``
    of each object, in order. References of an object to itself are left out. ``edges``: object, target."""
    depth = max(1, min(3, depth))
    rank = F.row_number().over(Window.partitionBy("target").orderBy("object"))
    near = edges.filter("object != target").select("object", "target").distinct().withColumn("rn", rank).filter(F.col("rn") <= per_node)
    front, seen, out = roots.select(F.col("object").alias("target")).distinct(), None, []
    for d in range(1, depth + 1):
        step = near.join(front, "target").select(F.col("target").alias("source"), F.col("object").alias("target"), F.lit(d).alias("depth"))
        out.append(step)
        seen = front if seen is None else seen.unionByName(front)
        front = step.select("target").distinct().join(seen, "target", "left_anti")
    return reduce(DataFrame.unionByName, out)


def parent_paths(rows: DataFrame, key: str = "id", parent: str = "parent", title: str = "title", guard: int = 50) -> DataFrame:
    """key, path: the titles from the root to each row, along parents; a chain longer than ``guard``, or a ring, is cut there.

    Chains are doubled, so ``guard`` steps take its logarithm of joins.
    """
    paths = rows.select(key, F.col(parent).alias("__up"), F.array(title).alias("path"))
    length = 1
    while length < guard:
        above = paths.select(F.col(key).alias("__up"), F.col("__up").alias("__next"), F.col("path").alias("__above"))
        paths = paths.join(above, "__up", "left").select(key, F.col("__next").alias("__up"), F.concat(F.coalesce("__above", F.array().cast("array<string>")), "path").alias("path"))
        length *= 2
    return paths.select(key, F.slice("path", F.greatest(F.size("path") - guard + 1, F.lit(1)), guard).alias("path"))
