"""The check of platform calls against the help: a verdict for each call site, and paged reports of verdicts.

``sites``: of ``platform_calls.sites_of``. ``entries``: of ``sources.help.entries``, one version's. A verdict has a level
(error, warning, unchecked) and a reason; calls that are fine have none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.call_sites import LISTED, MANAGERS
from quarry.functions.platform_calls import ALL, CLIENT
from quarry.operators.checks import minimum_mode, mode_warning
from quarry.operators.graph import common_key

LEVELS = ("error", "warning", "unchecked")
# Contexts that are none of a client's, and types whose members are not listed.
SERVER_CONTEXTS = ("сервер", "server", "внешнее соединение", "external connection", "мобильное приложение(сервер)", "мобильный автономный сервер")
DYNAMIC = ("comобъект", "comobject")
#: Rows of one page of a report at most.
PAGE = 500


def owner_type(owner: Column) -> Column:
    """An owner without the template of an object's name."""
    return F.substring_index(F.lower(owner), ".<", 1)


def _names(entries: DataFrame) -> Column:
    return F.filter(F.array_distinct(F.array(F.lower("name_ru"), F.lower(F.coalesce("name_en", F.lit(""))))), lambda x: x != "")


def _rule(entries: DataFrame, verified: Column | None = None) -> Column:
    return F.struct(minimum_mode(F.col("since"), F.col("compat"), verified).alias("mode"), F.col("availability"), F.lower("value_type").alias("type"))


def members(entries: DataFrame) -> DataFrame:
    """owner, name, rules: what the help says of each method of each type, and of the functions of all (owner empty).

    Names of both languages lead to the same rules; overloads are one array."""
    methods = entries.filter("kind in ('method', 'function')")
    owners = F.when(F.col("kind") == "function", F.array(F.lit(""))).otherwise(F.filter(F.array_distinct(F.array(owner_type(F.col("owner_ru")), owner_type(F.col("owner_en")))), lambda x: x != ""))
    rows = methods.select(F.explode(owners).alias("owner"), _names(entries).alias("names"), _rule(entries).alias("rule")).select("owner", F.explode("names").alias("name"), "rule")
    return rows.groupBy("owner", "name").agg(F.collect_list("rule").alias("rules"))


def types(entries: DataFrame) -> DataFrame:
    """owner, dynamic: every type and every owner of a method; dynamic ones have members that are not listed by name."""
    named = entries.filter("kind = 'type'").select(F.explode(_names(entries)).alias("owner"), F.lit(False).alias("dynamic"))
    template = F.exists(_names(entries), lambda n: F.contains(n, F.lit("<")))
    owning = entries.filter("kind = 'method'").select(F.explode(F.array(owner_type(F.col("owner_ru")), owner_type(F.col("owner_en")))).alias("owner"), template.alias("dynamic"))
    rows = named.unionByName(owning).filter("owner != ''").groupBy("owner").agg(F.bool_or("dynamic").alias("dynamic"))
    return rows.withColumn("dynamic", F.col("dynamic") | F.col("owner").isin(*DYNAMIC))


def properties(entries: DataFrame) -> DataFrame:
    """owner (empty for global ones), name, value (the type, null if there are several), rules."""
    rows = entries.filter("kind in ('property', 'global_property')")
    owners = F.when(F.col("kind") == "global_property", F.array(F.lit(""))).otherwise(F.filter(F.array_distinct(F.array(owner_type(F.col("owner_ru")), owner_type(F.col("owner_en")))), lambda x: x != ""))
    rows = rows.select(F.explode(owners).alias("owner"), _names(entries).alias("names"), _rule(entries).alias("rule")).select("owner", F.explode("names").alias("name"), "rule")
    value = F.when(F.countDistinct("rule.type") == 1, F.max(F.when(F.col("rule.type").rlike(r"^[\p{L}_][\p{L}\p{N}_]*$"), F.col("rule.type"))))
    return rows.groupBy("owner", "name").agg(value.alias("value"), F.collect_list("rule").alias("rules"))


def restrictions(rules: Column, mode: str, client: Column, subject: Column) -> Column:
    """Why all of the rules forbid a call: an older compatibility mode, or a client that has none of the contexts; else empty."""
    some = F.size(rules) > 0
    late = F.transform(rules, lambda r: mode_warning(r["mode"], F.lit(mode)))
    older = F.when(some & F.forall(late, lambda w: w.isNotNull()), F.concat(subject, F.lit(" "), F.get(late, F.lit(0))))
    contexts = lambda r: F.filter(F.transform(F.split(F.lower(F.coalesce(r["availability"], F.lit(""))), ","), lambda c: F.trim(c)), lambda c: c != "")
    away = some & client & F.forall(rules, lambda r: (F.size(contexts(r)) > 0) & F.forall(contexts(r), lambda c: c.isin(*SERVER_CONTEXTS)))
    return F.array_compact(F.array(older, F.when(away, F.concat(subject, F.lit(" is not available on clients, where the call runs")))))


def check(sites: DataFrame, entries: DataFrame, procedures: DataFrame, modules: DataFrame, objects: DataFrame | None = None, mode: str = "") -> DataFrame:
    """source_id, module, place, line, snippet, level, reason of the calls that are not fine.

    A call without a receiver is of its module, of a global module's export, of the module's own context, or of the
    platform. ``Collection.Object.Method`` is of the manager's module (an export) or of its type; an object that is not
    among ``objects`` is an error, and a warning where a guard proves it. Calls of common modules are left to the check
    of broken calls. A variable's type must be proven, or its property's be known. What can't be known is unchecked.
    """
    declared = procedures.groupBy(F.lower("module").alias("m"), F.lower("procedure").alias("name")).agg(F.bool_or("is_export").alias("exported"))
    known = procedures.select(F.lower("module").alias("m")).distinct()
    exports = procedures.filter("is_export").join(modules.filter("is_global").select("source_id", "module").distinct(), ["source_id", "module"], "left_semi").select(F.lower("procedure").alias("name")).distinct()
    vocabulary, owners, props = members(entries), types(entries), properties(entries)
    rows = sites.withColumn("m", F.lower("module")).withColumn("n", F.size("receiver")).withColumn("r0", F.get("receiver", F.lit(0))).withColumn("r1", F.get("receiver", F.lit(1)))
    collections = F.create_map(*[F.lit(x) for k, v in MANAGERS.items() for x in (k, v.lower())])
    rows = rows.withColumn("collection", F.when((F.col("n") == 2) & F.col("binding").isNull(), collections[F.col("r0")]))
    rows = rows.withColumn("object_key", F.concat_ws(".", "collection", F.when(F.col("collection").isNotNull(), F.col("r1"))))
    manager = F.when(F.col("collection").isNotNull(), F.concat("object_key", F.lit(".модульменеджера")))
    rows = rows.withColumn("manager", manager).withColumn("common", F.when((F.col("n") == 1) & F.col("binding").isNull(), common_key(F.col("r0"))))
    flag = lambda frame, keys, name: frame.select(*keys).distinct().withColumn(name, F.lit(True))
    rows = rows.join(declared.select("m", "name", F.lit(True).alias("is_own")), ["m", "name"], "left").join(flag(exports, ["name"], "is_global"), "name", "left")
    rows = rows.join(known.select(F.col("m").alias("manager"), F.lit(True).alias("has_manager")), "manager", "left")
    rows = rows.join(declared.select(F.col("m").alias("manager"), "name", F.col("exported").alias("manager_export")), ["manager", "name"], "left")
    rows = rows.join(known.select(F.col("m").alias("common"), F.lit(True).alias("is_common")), "common", "left")
    if objects is not None:
        rows = rows.join(objects.select(F.lower("object").alias("object_key"), F.lit(True).alias("has_object")).distinct(), "object_key", "left")
    else:
        rows = rows.withColumn("has_object", F.lit(True))
    # The property that names the receiver: a global one, or one of a variable's type.
    alone = (F.col("n") == 1) & F.col("binding").isNull()
    inner = (F.col("n") == 2) & (F.coalesce("binding", F.lit("")) != "")
    rows = rows.withColumn("p_owner", F.when(alone, F.lit("")).when(inner, F.col("binding"))).withColumn("p_name", F.when(alone, F.col("r0")).when(inner, F.col("r1")))
    rows = rows.join(props.select(F.col("owner").alias("p_owner"), F.col("name").alias("p_name"), F.col("value").alias("p_value"), F.col("rules").alias("p_rules")), ["p_owner", "p_name"], "left")
    kind = F.substring_index("m", ".", 1)
    own_type = F.when(F.col("m").endswith(".модульменеджера"), F.concat(kind, F.lit("менеджер"))).when(F.col("m").endswith(".модульобъекта"), F.concat(kind, F.lit("объект")))
    owner = (
        F.when(F.col("n") == 0, F.coalesce(own_type, F.lit("")))
        .when(F.col("collection").isNotNull(), F.concat("collection", F.lit("менеджер")))
        .when(F.col("n") == 1, F.coalesce("binding", "p_value", F.lit("")))
        .when(inner, F.coalesce("p_value", F.lit("")))
        .otherwise("")
    )
    rows = rows.withColumn("owner", owner).join(vocabulary, ["owner", "name"], "left")
    rows = rows.join(vocabulary.filter("owner = ''").select("name", F.col("rules").alias("function_rules")), "name", "left").join(owners, "owner", "left")
    # A property of a variable leads on only to a method that its type has.
    found = F.when((F.col("n") == 0) & F.col("rules").isNull(), F.col("function_rules")).when((F.col("n") > 0) & (F.col("owner") == ""), None).otherwise(F.col("rules"))
    rows = rows.withColumn("found", found)
    none = F.array().cast("array<string>")
    reasons = F.concat(
        F.when(F.col("p_rules").isNotNull() & (alone | F.col("found").isNotNull()), restrictions(F.col("p_rules"), mode, F.col("client"), F.concat(F.lit("the receiver "), F.col("p_name")))).otherwise(none),
        F.when(F.col("found").isNotNull(), restrictions(F.col("found"), mode, F.col("client"), F.lit("the method"))).otherwise(none),
    )
    rows = rows.withColumn("reasons", reasons)
    missing = F.col("collection").isin(*LISTED) & F.col("has_object").isNull() & F.col("has_manager").isNull()
    no_object = F.concat(F.lit("no object "), F.col("object_key"))
    implicit = (F.col("n") == 0) & own_type.isNull() & F.col("m").contains(".") & ~F.col("m").startswith("общиймодуль.")
    unknown_type = (F.col("n") > 0) & (F.col("dynamic").isNull() | (F.col("dynamic") & F.col("found").isNull()))
    fine, at = F.struct(F.lit(None).cast("string").alias("level"), F.lit(None).cast("string").alias("reason")), lambda level, reason: F.struct(F.lit(level).alias("level"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
    no_method = F.concat(F.lit("no method of that name: "), F.when(F.col("owner") != "", F.concat(F.lit("type "), F.col("owner"))).otherwise("global context"))
    base = (
        F.when(unknown_type, at("unchecked", "the receiver's type or its methods are unknown"))
        .when(F.col("found").isNull() & (implicit | ((F.col("owner") != "") & F.col("dynamic").isNull())), at("unchecked", "the methods of the context are unknown"))
        .when(F.col("found").isNull(), at("error", no_method))
        .otherwise(fine)
    )
    verdict = (
        F.when(F.col("split"), at("unchecked", "the preprocessor parts the receiver and the method"))
        .when((F.col("n") == 0) & (F.col("is_own") | F.coalesce("is_global", F.lit(False))), fine)
        .when((F.col("n") == 0) & F.coalesce("is_global", F.lit(False)), fine)
        .when(F.col("has_manager") & F.col("manager_export"), fine)
        .when(F.col("has_manager") & ~F.col("manager_export"), at("error", "a method of the manager that is not exported"))
        .when(missing & F.array_contains("guarded", F.col("object_key")), at("warning", F.concat(no_object, F.lit(", which a guard asks for"))))
        .when(missing, at("error", no_object))
        .when(F.col("is_common"), fine)
        .when(F.size("reasons") > 0, at("warning", F.concat_ws(". ", F.array_join("reasons", ". "), base["reason"])))
        .otherwise(base)
    )
    return rows.withColumn("v", verdict).filter("v.level is not null").select("source_id", "module", "place", "line", "snippet", "v.level", "v.reason")


def client_only(mask: Column) -> Column:
    """Whether a mask of environments has some of clients and no other."""
    return (mask.bitwiseAND(F.lit(CLIENT)) != 0) & (mask.bitwiseAND(F.lit(ALL ^ CLIENT)) == 0)


def remaining(mask: Column, taken: Column) -> Column:
    """The environments of a mask that a branch before has not taken."""
    return mask.bitwiseAND(F.bitwise_not(taken)).bitwiseAND(F.lit(ALL))


# -- reports --------------------------------------------------------------------------------------------------------------


def write_report(verdicts: DataFrame, path: str, parts: int = 16) -> None:
    """Write verdicts by level, each numbered in the order of source, module and place, so that a page is a range.

    Numbers are counted from ranges of the order: a running sum of the ranges' sizes, then a number within each. The
    ranges are written first (``path`` with -ranges), so that both are of the same ones.
    """
    order = ["source_id", "module", "place"]
    verdicts.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()).write.mode("overwrite").parquet(f"{path}-ranges")
    dealt = verdicts.sparkSession.read.parquet(f"{path}-ranges")
    sizes = dealt.groupBy("level", "part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("level").orderBy("part")) - F.col("n")).drop("n")
    rows = dealt.join(F.broadcast(before), ["level", "part"])  # a row for each level and part
    number = F.row_number().over(Window.partitionBy("level", "part").orderBy(*order)) + F.col("before") - 1
    rows.withColumn("pos", number.cast("long")).drop("part", "before").write.mode("overwrite").partitionBy("level").parquet(path)


def level_counts(report: DataFrame) -> DataFrame:
    """level, n of every level, those without rows too."""
    spark = report.sparkSession
    levels = spark.createDataFrame([(v, i) for i, v in enumerate(LEVELS)], "level string, rank int")
    return levels.join(report.groupBy("level").agg(F.count(F.lit(1)).alias("n")), "level", "left").select("level", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "rank").orderBy("rank").drop("rank")


def page(report: DataFrame, levels: list[str] | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of a report in the order of source, module and place. One level's page is a range of its numbers; several
    levels' are merged, and only their first offset + limit rows take part."""
    limit = min(limit, PAGE)
    wanted = levels or list(LEVELS)
    if len(wanted) == 1:
        return report.filter((F.col("level") == wanted[0]) & F.col("pos").between(offset, offset + limit - 1)).orderBy("pos")
    first = reduce(DataFrame.unionByName, [report.filter((F.col("level") == v) & (F.col("pos") < offset + limit)) for v in wanted])
    return first.orderBy("source_id", "module", "place").offset(offset).limit(limit)


def source_ranges(report: DataFrame) -> DataFrame:
    """level, source_id, first, last: where each source's rows stand among a level's numbers."""
    return report.groupBy("level", "source_id").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
