"""Queries over an index that is made of the test tables: modules and procedures of ``part``, calls of ``lineitem``.

Parts are procedures of three sources; a line calls the part of its supplier's number, by a kind that its line number
tells; some names are spoilt, so that they are nowhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators import checks, graph, lifecycle, metrics, objects, search
from quarry.operators import platform as verdicts
from quarry.plans.registry import entry, read

INDEX = r"""
    sources AS (SELECT * FROM (VALUES ('main', 'main'), ('ext1', 'extension'), ('ext2', 'extension')) AS t(source_id, source_type)),
    procedures AS (
        SELECT p_partkey AS proc_id, CASE p_partkey % 5 WHEN 0 THEN 'ext1' WHEN 1 THEN 'ext2' ELSE 'main' END AS source_id,
               CASE p_partkey % 4 WHEN 0 THEN 'ОбщийМодуль.' || replace(p_brand, '#', '') || '.Модуль' WHEN 1 THEN replace(p_brand, '#', '')
                   WHEN 2 THEN 'Справочник.' || replace(p_brand, '#', '') || '.МодульМенеджера' ELSE 'Документ.' || replace(p_brand, '#', '') || '.МодульМенеджера' END AS module,
               replace(p_name, ' ', '_') AS procedure, p_size > 20 AS is_export, p_size % 7 AS start_line
        FROM part),
    modules AS (SELECT source_id, module, bool_or(module LIKE 'ОбщийМодуль.%1.Модуль') AS is_global FROM procedures GROUP BY 1, 2),
    lines AS (SELECT *, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(l_quantity AS INTEGER) AS call_id, CASE l_linenumber % 5 WHEN 0 THEN 'local' WHEN 1 THEN 'common_module' WHEN 2 THEN 'manager' WHEN 3 THEN 'manager_object' ELSE 'override' END AS kind FROM lineitem),
    calls AS (
        SELECT call_id, c.proc_id, c.source_id, c.module, c.procedure AS caller, l_linenumber AS line, kind,
               CASE kind WHEN 'local' THEN '' WHEN 'common_module' THEN replace(t.p_brand, '#', '') WHEN 'override' THEN c.module ELSE 'Справочник.' || replace(t.p_brand, '#', '') || '.МодульМенеджера' END AS callee_module,
               CASE WHEN l_quantity > 45 THEN 'no_' || replace(t.p_name, ' ', '_') ELSE replace(t.p_name, ' ', '_') END AS callee, l_tax
        FROM lines JOIN procedures c ON c.proc_id = l_partkey JOIN part t ON t.p_partkey = l_suppkey)"""

RESOLVED = (
    INDEX
    + r""",
    keys AS (SELECT proc_id, source_id, lower(module) AS k, lower(procedure) AS n FROM procedures
             UNION ALL SELECT proc_id, source_id, 'общиймодуль.' || lower(module) || '.модуль', lower(procedure) FROM procedures WHERE NOT contains(module, '.')),
    asked AS (SELECT *, CASE kind WHEN 'common_module' THEN 'общиймодуль.' || lower(callee_module) || '.модуль' ELSE lower(callee_module) END AS k, lower(callee) AS n FROM calls),
    homes AS (SELECT k, n, source_id, min(proc_id) AS proc_id FROM keys GROUP BY 1, 2, 3),
    cand AS (
        SELECT call_id, max(p.proc_id) AS target, 'exact' AS confidence, 0 AS tier FROM asked c JOIN procedures p ON p.source_id = c.source_id AND lower(p.module) = lower(c.module) AND lower(p.procedure) = c.n WHERE kind = 'local' GROUP BY 1
        UNION ALL SELECT call_id, g.target, 'name_only', 1 FROM asked c JOIN (
            SELECT lower(procedure) AS n, arg_min(proc_id, (CASE source_type WHEN 'extension' THEN 0 ELSE 1 END) * 1000000000 + proc_id) AS target FROM procedures JOIN modules USING (source_id, module) JOIN sources USING (source_id) WHERE is_export AND is_global GROUP BY 1) g ON g.n = c.n WHERE kind = 'local'
        UNION ALL SELECT call_id, arg_min(h.proc_id, (CASE source_type WHEN 'extension' THEN 0 ELSE 1 END) * 1000000000 + h.proc_id), 'exact', 0 FROM asked c JOIN homes h ON h.k = c.k AND h.n = c.n JOIN sources s ON s.source_id = h.source_id
            WHERE kind IN ('common_module', 'manager') OR kind = 'manager_object' AND c.n NOT IN ('small_ring', 'red_widget') GROUP BY 1
        UNION ALL SELECT call_id, arg_min(h.proc_id, (CASE source_type WHEN 'main' THEN 0 ELSE 1 END) * 1000000000 + h.proc_id), 'override', 0 FROM asked c JOIN homes h ON h.k = c.k AND h.n = c.n AND h.source_id <> c.source_id JOIN sources s ON s.source_id = h.source_id WHERE kind = 'override' GROUP BY 1),
    best AS (SELECT call_id, arg_min(target, tier) AS target, arg_min(confidence, tier) AS confidence FROM cand GROUP BY 1),
    resolved AS (SELECT c.*, target, confidence FROM calls c LEFT JOIN best USING (call_id))"""
)


def index(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    part, line = read(spark, sf_dir, "part"), read(spark, sf_dir, "lineitem")
    brand, name = (lambda p="": F.replace(F.col(f"{p}p_brand"), F.lit("#"), F.lit(""))), (lambda p="": F.replace(F.col(f"{p}p_name"), F.lit(" "), F.lit("_")))
    key = F.col("p_partkey")
    manager = lambda kind, b: F.concat(F.lit(f"{kind}."), b, F.lit(".МодульМенеджера"))
    module = F.when(key % 4 == 0, graph_common(brand())).when(key % 4 == 1, brand()).when(key % 4 == 2, manager("Справочник", brand())).otherwise(manager("Документ", brand()))
    source = F.when(key % 5 == 0, "ext1").when(key % 5 == 1, "ext2").otherwise("main")
    procedures = part.select(key.alias("proc_id"), source.alias("source_id"), module.alias("module"), name().alias("procedure"), (F.col("p_size") > 20).alias("is_export"), (F.col("p_size") % 7).alias("start_line"))
    modules = procedures.groupBy("source_id", "module").agg(F.bool_or(F.col("module").rlike(r"^ОбщийМодуль\..*1\.Модуль$")).alias("is_global"))
    n = F.col("l_linenumber") % 5
    kind = F.when(n == 0, "local").when(n == 1, "common_module").when(n == 2, "manager").when(n == 3, "manager_object").otherwise("override")
    lines = line.withColumn("call_id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"))).withColumn("kind", kind)
    lines = lines.join(procedures.withColumnRenamed("proc_id", "l_partkey"), "l_partkey").join(part.select(key.alias("l_suppkey"), brand().alias("t_brand"), name().alias("t_name")), "l_suppkey")
    target = F.when(F.col("kind") == "local", "").when(F.col("kind") == "common_module", F.col("t_brand")).when(F.col("kind") == "override", F.col("module")).otherwise(manager("Справочник", F.col("t_brand")))
    callee = F.when(F.col("l_quantity") > 45, F.concat(F.lit("no_"), "t_name")).otherwise(F.col("t_name"))
    calls = lines.select("call_id", F.col("l_partkey").alias("proc_id"), "source_id", "module", F.col("procedure").alias("caller"), F.col("l_linenumber").alias("line"), "kind", target.alias("callee_module"), callee.alias("callee"), "l_tax")
    sources = spark.createDataFrame([("main", "main"), ("ext1", "extension"), ("ext2", "extension")], "source_id string, source_type string")
    return {"sources": sources, "procedures": procedures, "modules": modules, "calls": calls}


def graph_common(brand):
    return F.concat(F.lit("ОбщийМодуль."), brand, F.lit(".Модуль"))


def resolved(spark: SparkSession, sf_dir: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    t = tables or index(spark, sf_dir)
    platform = spark.createDataFrame([("Справочник", "small_ring"), ("Справочник", "red_widget")], "kind string, method string")
    return graph.resolve_calls(t["calls"], t["procedures"], t["modules"], t["sources"], platform)


@entry(f"WITH {RESOLVED} SELECT call_id, kind, target, confidence FROM resolved")
def resolve_calls_tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(spark, sf_dir).select("call_id", "kind", "target", "confidence")


@entry(f"""
    WITH {RESOLVED}, r AS (SELECT *, row_number() OVER (PARTITION BY proc_id, callee, callee_module ORDER BY target IS NULL, line, call_id) AS rn, min(line * 1000000000000 + 0) OVER (PARTITION BY proc_id, callee, callee_module) AS x FROM resolved WHERE kind <> 'manager_object' OR target IS NOT NULL)
    SELECT proc_id AS node, target, CASE WHEN callee_module <> '' THEN callee_module || '.' || callee ELSE callee END AS name, line, coalesce(confidence, 'none') AS confidence FROM r WHERE rn = 1""")
def call_tree_lines_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.callees(resolved(spark, sf_dir)).select("node", "target", "name", "line", "confidence")


@entry(f"""
    WITH {RESOLVED}, r AS (SELECT target AS node, proc_id, confidence, min(line) AS line FROM resolved WHERE target IS NOT NULL GROUP BY 1, 2, 3)
    SELECT node, r.proc_id AS target, module || '.' || procedure AS name, line, confidence, CAST(row_number() OVER (PARTITION BY node ORDER BY source_id, module, procedure, r.proc_id, confidence) AS INTEGER) AS pos FROM r JOIN procedures p ON p.proc_id = r.proc_id""")
def call_tree_lines_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = index(spark, sf_dir)
    return graph.callers(resolved(spark, sf_dir, t), t["procedures"])


@entry(f"""
    WITH {RESOLVED} SELECT b.module, b.procedure, r.source_id, p.procedure AS ext_procedure, '' AS directive FROM resolved r JOIN procedures p ON p.proc_id = r.proc_id AND p.start_line = r.line JOIN procedures b ON b.proc_id = r.target
    WHERE r.confidence = 'override' AND b.source_id <> r.source_id""")
def interceptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = index(spark, sf_dir)
    return graph.intercepts(resolved(spark, sf_dir, t), t["procedures"].withColumn("directive", F.lit("")))


@entry(f"""
    WITH {RESOLVED}, d AS (SELECT CASE kind WHEN 'manager_object' THEN 'manager' ELSE kind END AS kind, count(*) AS total, count(target) AS resolved FROM resolved GROUP BY 1 UNION ALL SELECT NULL, count(*), count(target) FROM resolved)
    SELECT kind, total, resolved, round(100.0 * resolved / total, 1) AS pct FROM d""")
def resolution_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.overall(resolved(spark, sf_dir), "call_id", "kind", "target", {"manager_object": "manager"})


EXPORTS = r"""
    exports AS (SELECT k, n, bool_or(is_export) AS exported FROM (
        SELECT lower(module) AS k, lower(procedure) AS n, is_export FROM procedures UNION ALL SELECT 'общиймодуль.' || lower(module) || '.модуль', lower(procedure), is_export FROM procedures WHERE NOT contains(module, '.')) GROUP BY 1, 2),
    shorts AS (SELECT DISTINCT CASE WHEN contains(module, '.') THEN split_part(lower(module), '.', 2) ELSE lower(module) END AS short FROM procedures)"""

BROKEN = (
    RESOLVED
    + ","
    + EXPORTS
    + r""",
    suspects AS (
        SELECT r.*, r.line AS l, CASE kind WHEN 'common_module' THEN 'общиймодуль.' || lower(callee_module) || '.модуль' ELSE lower(callee_module) END AS k, lower(callee) AS n, l_tax = 0 AS plain
        FROM resolved r LEFT JOIN procedures t ON t.proc_id = r.target WHERE kind IN ('common_module', 'manager', 'manager_object') AND (target IS NULL OR NOT t.is_export)),
    known AS (SELECT lower('Справочник.' || replace(p_brand, '#', '')) AS object_key FROM part WHERE p_partkey % 3 = 0 UNION SELECT replace(lower(module), '.модульменеджера', '') FROM procedures WHERE lower(module) LIKE '%.модульменеджера'),
    judged AS (
        SELECT s.*, e.exported, (SELECT count(*) FROM exports x WHERE x.k = s.k) > 0 AS has_module,
               CASE WHEN contains(callee_module, '.') THEN split_part(lower(callee_module), '.', 2) ELSE lower(callee_module) END IN (SELECT short FROM shorts) AS has_short,
               kind <> 'common_module' AND replace(s.k, '.модульменеджера', '') NOT IN (SELECT object_key FROM known) AS lost
        FROM suspects s LEFT JOIN exports e ON e.k = s.k AND e.n = s.n),
    broken AS (
        SELECT call_id, module, callee_module, callee, CASE kind WHEN 'manager_object' THEN 'manager' ELSE kind END AS kind, lost AS missing_object, caller, l AS line,
               CASE WHEN lost THEN 'missing' WHEN kind <> 'common_module' AND n IN ('small_ring') THEN NULL WHEN NOT has_module AND (kind = 'manager_object' OR target IS NOT NULL OR has_short) THEN NULL WHEN NOT has_module THEN 'external'
                   WHEN (exported IS NULL OR NOT exported AND lower(module) <> k) AND kind = 'common_module' AND NOT plain THEN 'dynamic' WHEN exported IS NULL THEN 'missing' WHEN NOT exported AND lower(module) <> k THEN 'not_export' END AS problem
        FROM judged)"""
)


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = index(spark, sf_dir)
    rows = resolved(spark, sf_dir, t).withColumn("context", F.when(F.col("l_tax") == 0, F.concat(F.lit("A = "), "callee_module", F.lit(" . "), "callee", F.lit(" (1);"))).otherwise("M.Do();"))
    listed = read(spark, sf_dir, "part").filter("p_partkey % 3 = 0").select(F.concat(F.lit("Справочник."), F.replace("p_brand", F.lit("#"), F.lit(""))).alias("object")).distinct()
    methods = spark.createDataFrame([("Справочник", "small_ring")], "kind string, method string")
    return checks.broken_calls(rows, t["procedures"], listed, platform_methods=methods)


@entry(f"WITH {BROKEN} SELECT call_id, kind, callee_module, callee, problem, missing_object FROM broken WHERE problem IS NOT NULL")
def broken_calls_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _broken(spark, sf_dir).select("call_id", "kind", "callee_module", "callee", "problem", "missing_object")


@entry(f"""
    WITH {BROKEN}, homes3 AS (SELECT n, string_agg(module || ' ' || source_id, ',' ORDER BY rn) AS hints FROM (SELECT n, module, source_id, row_number() OVER (PARTITION BY n ORDER BY module, source_id) AS rn FROM (SELECT DISTINCT lower(procedure) AS n, module, source_id FROM procedures)) WHERE rn <= 3 GROUP BY 1)
    SELECT call_id, coalesce(hints, '') AS hints FROM broken LEFT JOIN homes3 ON n = lower(callee) WHERE problem = 'missing' AND NOT missing_object""")
def broken_call_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _broken(spark, sf_dir).filter("problem = 'missing' and not missing_object")
    return rows.select("call_id", F.array_join(F.transform("defined_in", lambda d: F.concat_ws(" ", d["module"], d["source_id"])), ",").alias("hints"))


@entry(f"""
    WITH {RESOLVED},{EXPORTS}, u AS (SELECT kind, callee_module, callee, count(*) AS freq FROM resolved WHERE target IS NULL AND kind IN ('common_module', 'manager') GROUP BY 1, 2, 3),
    j AS (SELECT *, CASE kind WHEN 'common_module' THEN 'общиймодуль.' || lower(callee_module) || '.модуль' ELSE lower(callee_module) END AS k FROM u),
    c AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM exports e WHERE e.k = j.k AND e.n = lower(callee)) THEN 'other' WHEN EXISTS (SELECT 1 FROM exports e WHERE e.k = j.k) THEN 'method_missing'
        WHEN CASE WHEN contains(callee_module, '.') THEN split_part(lower(callee_module), '.', 2) ELSE lower(callee_module) END IN (SELECT short FROM shorts) THEN 'other' ELSE 'module_missing' END AS cause FROM j),
    t AS (SELECT *, row_number() OVER (PARTITION BY cause ORDER BY freq DESC, callee_module, callee, kind) AS rn FROM c)
    SELECT cause, CAST(sum(freq) AS BIGINT) AS calls, round(100.0 * sum(freq) / (SELECT sum(freq) FROM c), 1) AS pct, string_agg(callee_module || '.' || callee || ':' || freq, ',' ORDER BY rn) FILTER (rn <= 5) AS top FROM t GROUP BY 1""")
def unresolved_breakdown_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = index(spark, sf_dir)
    shares = checks.cause_shares(checks.unresolved_causes(resolved(spark, sf_dir, t), t["procedures"]), 5)
    top = F.transform("top", lambda x: F.concat(x["callee_module"], F.lit("."), x["callee"], F.lit(":"), x["freq"].cast("string")))
    return shares.select("cause", "calls", "pct", F.array_join(top, ",").alias("top"))


@entry("""
    WITH r AS (SELECT p_brand, p_partkey, p_size AS a, p_size + 9 AS b FROM part WHERE p_partkey % 3 = 0),
    j AS (SELECT p.p_partkey AS site, r.p_partkey AS target, row_number() OVER (PARTITION BY p.p_partkey ORDER BY r.a DESC, r.p_partkey) AS rn FROM part p LEFT JOIN r ON p.p_brand = r.p_brand AND p.p_size BETWEEN r.a AND r.b)
    SELECT site, target FROM j WHERE rn = 1""")
def line_to_procedure_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    points = part.select("p_brand", F.col("p_partkey").alias("site"), F.col("p_size").alias("at"))
    ranges = part.filter("p_partkey % 3 = 0").select("p_brand", F.col("p_partkey").alias("target"), F.col("p_size").alias("a"), (F.col("p_size") + 9).alias("b"))
    return graph.enclosing(points, ranges, "p_brand", "at", "a", "b", "target").select("site", "target")


# -- completeness, versions, states ---------------------------------------------------------------------------------------


@entry("""
    WITH f AS (SELECT DISTINCT 'M.' || p_brand || '.X' AS module, replace(p_name, ' ', '_') AS procedure FROM part WHERE p_partkey % 4 > 0), i AS (SELECT DISTINCT p_brand AS module, replace(p_name, ' ', '_') AS procedure FROM part WHERE p_size > 10)
    SELECT 'missing' AS side, module, procedure FROM f WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.procedure = f.procedure AND (contains(i.module, f.module) OR contains(f.module, i.module)))
    UNION ALL SELECT 'extra', module, procedure FROM i WHERE NOT EXISTS (SELECT 1 FROM f WHERE i.procedure = f.procedure AND (contains(i.module, f.module) OR contains(f.module, i.module)))""")
def index_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").withColumn("procedure", F.replace("p_name", F.lit(" "), F.lit("_")))
    text = part.filter("p_partkey % 4 > 0").groupBy(F.concat(F.lit("M."), "p_brand", F.lit(".X")).alias("module")).agg(F.array_join(F.collect_list(F.concat(F.lit(" Procedure "), "procedure", F.lit(" (A) Export\nEndProcedure\n"))), "\n").alias("text"))
    indexed = part.filter("p_size > 10").select(F.col("p_brand").alias("module"), "procedure")
    return checks.completeness(text, indexed).select("side", "module", "procedure")


@entry("""
    WITH v AS (SELECT p_partkey, '8.' || p_size % 4 || '.' || p_partkey % 30 AS since, CASE WHEN p_partkey % 3 = 0 THEN '8.2.' || p_size ELSE '' END AS compat FROM part),
    m AS (SELECT *, CASE WHEN compat <> '' AND list_transform(string_split(compat, '.'), lambda x: x::INTEGER) > list_transform(string_split(since, '.'), lambda x: x::INTEGER) THEN compat ELSE since END AS least FROM v)
    SELECT p_partkey, least, CASE WHEN list_transform(string_split(least, '.'), lambda x: x::INTEGER) > [8, 2, 15] THEN 'needs mode ' || least || ' or later, the mode is 8.2.15' END AS warning FROM m""")
def version_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    since = F.concat_ws(".", F.lit("8"), F.col("p_size") % 4, F.col("p_partkey") % 30)
    compat = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("8.2."), "p_size")).otherwise("")
    rows = part.select("p_partkey", checks.minimum_mode(since, compat).alias("least"))
    return rows.select("p_partkey", "least", checks.mode_warning(F.col("least"), F.lit("8.2.15")).alias("warning"))


@entry("""
    WITH v AS (SELECT '8.' || p_size % 4 || '.' || p_partkey % 30 AS version, p_partkey % 7 = 0 AS corrupt FROM part)
    SELECT arg_max(version, list_transform(string_split(version, '.'), lambda x: x::INTEGER)) AS version FROM v WHERE NOT corrupt""")
def newest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select(F.concat_ws(".", F.lit("8"), F.col("p_size") % 4, F.col("p_partkey") % 30).alias("version"), (F.col("p_partkey") % 7 == 0).alias("corrupt"))
    return checks.newest(rows)


@entry("""
    WITH s AS (SELECT event_id, value AS size, event_type AS hash, CASE WHEN event_id % 20 = 0 THEN 'old' ELSE 'p1' END AS parser FROM events WHERE event_id % 9 <> 0),
    n AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN value + 1 ELSE value END AS size, CASE WHEN event_id % 8 = 0 THEN 'new' ELSE event_type END AS hash FROM events WHERE event_id % 10 <> 0)
    SELECT coalesce(s.event_id, n.event_id) AS event_id, CASE WHEN s.event_id IS NULL THEN 'read' WHEN n.event_id IS NULL THEN 'delete' WHEN parser <> 'p1' THEN 'read' WHEN s.size = n.size THEN 'keep' WHEN s.hash = n.hash THEN 'touch' ELSE 'read' END AS action
    FROM s FULL JOIN n ON s.event_id = n.event_id""")
def incremental_changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", F.col("value").alias("file_size"), F.lit(0).alias("mtime"), F.col("event_type").alias("file_hash"))
    stored = e.filter("event_id % 9 != 0").withColumn("parser", F.when(F.col("event_id") % 20 == 0, "old").otherwise("p1"))
    now = e.filter("event_id % 10 != 0").withColumn("file_hash", F.when(F.col("event_id") % 8 == 0, "new").otherwise(F.col("file_hash"))).withColumn("file_size", F.when(F.col("event_id") % 4 == 0, F.col("file_size") + 1).otherwise(F.col("file_size")))
    return lifecycle.plan_files(stored, now, "p1", "event_id")


@entry("""
    WITH s AS (SELECT o_custkey % 3 AS source_id, * FROM orders) SELECT (SELECT count(*) FROM s WHERE source_id = 1) AS objects, (SELECT count(*) FROM lineitem WHERE l_partkey % 3 = 1) AS calls, (SELECT count(*) FROM part WHERE p_partkey % 3 = 1) AS procedures""")
def source_removal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {n: read(spark, sf_dir, t).withColumn("source_id", (F.col(k) % 3).cast("string")) for n, t, k in (("objects", "orders", "o_custkey"), ("calls", "lineitem", "l_partkey"), ("procedures", "part", "p_partkey"))}
    return lifecycle.source_counts(tables, "1")


@entry(f"""
    WITH {INDEX}, cards AS (SELECT source_id, module, CASE WHEN min(proc_id) % 2 = 0 THEN 1 ELSE 0 END AS card_format FROM procedures GROUP BY 1, 2),
    c AS (SELECT m.source_id, count(*) AS modules, count(*) AS with_code, CAST(sum(card_format) AS BIGINT) AS cards_current FROM modules m JOIN cards USING (source_id, module) GROUP BY 1)
    SELECT source_id, modules, source_id <> 'ext2' AS parser_current, with_code, cards_current, array_to_string(list_filter([CASE WHEN source_id = 'ext2' THEN 'read by another parser' END, CASE WHEN cards_current < with_code THEN 'cards are missing' END], lambda x: x IS NOT NULL), ',') AS issues FROM c""")
def index_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = index(spark, sf_dir)
    cards = t["procedures"].groupBy("source_id", "module").agg(F.when(F.min("proc_id") % 2 == 0, 1).otherwise(0).alias("card_format"))
    sources = t["sources"].select("source_id", F.col("source_id").alias("label"), F.lit("2024-01-01").alias("indexed_at"))
    parsers = t["sources"].select("source_id", F.when(F.col("source_id") == "ext2", "old").otherwise("p1").alias("parser"))
    rows = lifecycle.readiness(sources, t["modules"], t["procedures"], cards, parsers, "p1", 1)
    return rows.select("source_id", "modules", "parser_current", "with_code", "cards_current", F.array_join("issues", ",").alias("issues"))


@entry("""
    WITH r AS (SELECT event_type AS method, event_id % 3 AS k, event_id % 5 > 0 AS expected, CASE WHEN event_id % 4 < 3 THEN user_id % 12 + 1 END AS rank, event_id % 4 AS returned, value AS ms FROM events),
    t AS (SELECT method, ms, row_number() OVER (PARTITION BY method ORDER BY ms) AS place, count(*) OVER (PARTITION BY method) AS n FROM r),
    p AS (SELECT method, median(ms) AS ms_p50, max(ms) FILTER (place = greatest(floor(n * 0.95), 1)) AS ms_p95 FROM t GROUP BY 1),
    a AS (SELECT method, NULL AS kind, count(*) FILTER (expected) AS n, count(*) FILTER (expected AND rank = 1) AS h1, count(*) FILTER (expected AND rank <= 5) AS h5, count(*) FILTER (expected AND rank <= 10) AS h10, sum(1.0 / rank) FILTER (expected) AS mrr, count(*) FILTER (NOT expected) AS negatives, count(*) FILTER (NOT expected AND returned > 0) AS negatives_with_results FROM r GROUP BY 1
          UNION ALL SELECT method, k::VARCHAR, count(*), count(*) FILTER (rank = 1), count(*) FILTER (rank <= 5), count(*) FILTER (rank <= 10), sum(1.0 / rank), 0, 0 FROM r WHERE expected GROUP BY 1, 2)
    SELECT a.method, kind, n, round(h1 / n, 6) AS hit1, round(h5 / n, 6) AS hit5, round(h10 / n, 6) AS hit10, round(coalesce(mrr, 0) / n, 6) AS mrr, negatives, negatives_with_results, CASE WHEN kind IS NULL THEN round(ms_p50, 6) END AS ms_p50, CASE WHEN kind IS NULL THEN ms_p95 END AS ms_p95 FROM a JOIN p USING (method)""")
def search_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    i = F.col("event_id")
    rows = e.select(F.col("event_type").alias("method"), (i % 3).cast("string").alias("kind"), (i % 5 > 0).alias("expected"), F.when(i % 4 < 3, F.col("user_id") % 12 + 1).alias("rank"), (i % 4).alias("returned"), F.col("value").alias("ms"))
    out = metrics.evaluation(rows)
    return out.select("method", "kind", "n", *[F.round(c, 6).alias(c) for c in ("hit1", "hit5", "hit10", "mrr")], "negatives", "negatives_with_results", F.round("ms_p50", 6).alias("ms_p50"), "ms_p95")


# -- objects --------------------------------------------------------------------------------------------------------------

TYPES = "CASE o_orderkey % 4 WHEN 0 THEN 'CatalogRef.C' || o_custkey % 40 WHEN 1 THEN 'String(10, Variable), DocumentRef.C' || o_custkey % 40 || 'X' WHEN 2 THEN 'Number(5, 2), CatalogRef.C' || o_custkey % 30 || ', Date(Date)' ELSE 'Boolean' END"


def _attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    type_ = (
        F.when(k % 4 == 0, F.concat(F.lit("CatalogRef.C"), c % 40)).when(k % 4 == 1, F.concat(F.lit("String(10, Variable), DocumentRef.C"), c % 40, F.lit("X")))
        .when(k % 4 == 2, F.concat(F.lit("Number(5, 2), CatalogRef.C"), c % 30, F.lit(", Date(Date)"))).otherwise("Boolean")
    )
    return read(spark, sf_dir, "orders").select(F.concat(F.lit("Catalog.C"), c).alias("object"), F.concat(F.lit("A"), k).alias("attribute"), type_.alias("type_desc"))


@entry(f"""
    WITH a AS (SELECT 'Catalog.C' || o_custkey AS object, 'A' || o_orderkey AS attribute, {TYPES} AS type_desc FROM orders)
    SELECT object, attribute, type_desc, regexp_matches(lower(type_desc), 'ref\\.c7(,|$)') AS exact FROM a WHERE contains(lower(type_desc), 'c7') ORDER BY exact DESC, object, attribute LIMIT 100""")
def find_references_exact_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects.find_references(_attributes(spark, sf_dir), "Catalog.C7", 100)


REFERENCES = f"""
    a AS (SELECT 'Catalog.C' || o_custkey AS object, 'A' || o_orderkey AS attribute, {TYPES} AS type_desc FROM orders),
    t AS (SELECT object, attribute, unnest(regexp_extract_all(type_desc, 'CatalogRef\\.([A-Za-z0-9]+)', 1)) AS name FROM a),
    refs AS (SELECT DISTINCT object, attribute, 'Catalog.C' || c_custkey AS target FROM t JOIN customer ON name = 'C' || c_custkey)"""


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = read(spark, sf_dir, "customer").select(F.concat(F.lit("Catalog.C"), "c_custkey").alias("object"), F.lit("Catalog").alias("kind"), F.concat(F.lit("C"), "c_custkey").alias("name"))
    return objects.references(_attributes(spark, sf_dir), known)


@entry(f"WITH {REFERENCES} SELECT object, attribute, target FROM refs")
def type_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _references(spark, sf_dir)


@entry(f"""
    WITH {REFERENCES}, e AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY object) AS rn FROM (SELECT DISTINCT object, target FROM refs WHERE object <> target)), n AS (SELECT * FROM e WHERE rn <= 20),
    one AS (SELECT target AS source, object AS target, 1 AS depth FROM n WHERE target IN ('Catalog.C7', 'Catalog.C8')),
    two AS (SELECT n.target AS source, n.object AS target, 2 AS depth FROM n WHERE n.target IN (SELECT target FROM one) AND n.target NOT IN ('Catalog.C7', 'Catalog.C8'))
    SELECT * FROM one UNION ALL SELECT * FROM two""")
def reference_graph_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = spark.createDataFrame([("Catalog.C7",), ("Catalog.C8",)], "object string")
    return objects.reference_graph(_references(spark, sf_dir), roots, 2, 20)


@entry("""
    WITH q AS (SELECT 'R' || page_id AS report, 'SELECT Catalog.' || regexp_extract(url, '([a-z]+)', 1) || '.Ref FROM Document.D' || page_id % 7 || ' AS X, document.d' || page_id % 7 || ', Register.Z, справочник.C' || page_id % 50 AS query FROM pages),
    refs AS (SELECT report, 'Документ.D' || page_id % 7 AS ref FROM pages JOIN q ON report = 'R' || page_id UNION SELECT report, 'Справочник.' || regexp_extract(url, '([a-z]+)', 1) FROM pages JOIN q ON report = 'R' || page_id UNION SELECT report, 'Справочник.C' || page_id % 50 FROM pages JOIN q ON report = 'R' || page_id),
    known AS (SELECT DISTINCT 'Справочник.C' || c_custkey AS object FROM customer WHERE c_custkey < 60 UNION SELECT 'Документ.D1' UNION SELECT 'Документ.D3')
    SELECT object, coalesce(string_agg(report, ',' ORDER BY report), '') AS used_by, count(report) AS n FROM known LEFT JOIN refs ON lower(ref) = lower(object) GROUP BY 1""")
def knowledge_used_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    query = F.concat(F.lit("SELECT Catalog."), F.regexp_extract("url", "([a-z]+)", 1), F.lit(".Ref FROM Document.D"), k % 7, F.lit(" AS X, document.d"), k % 7, F.lit(", Register.Z, справочник.C"), k % 50)
    queries = read(spark, sf_dir, "pages").select(F.concat(F.lit("R"), k).alias("report"), query.alias("query"))
    known = read(spark, sf_dir, "customer").filter("c_custkey < 60").select(F.concat(F.lit("Справочник.C"), "c_custkey").alias("object"), F.lit("Справочник").alias("kind"))
    known = known.unionByName(spark.createDataFrame([("Документ.D1", "Документ"), ("Документ.D3", "Документ")], "object string, kind string"))
    out = objects.used_by(queries, known, ("Справочник", "Документ"))
    return out.select("object", F.array_join("used_by", ",").alias("used_by"), F.size("used_by").cast("long").alias("n"))


@entry("""
    WITH a AS (SELECT o_custkey, 'A' || o_orderkey AS attribute, o_orderpriority AS type_desc, row_number() OVER (PARTITION BY o_custkey ORDER BY 'A' || o_orderkey) AS rn FROM orders WHERE o_orderkey % 5 > 0),
    l AS (SELECT o_custkey, string_agg(attribute || ':' || type_desc, ',' ORDER BY attribute) FILTER (rn <= 30) AS attributes, count(*) AS n FROM a GROUP BY 1),
    s AS (SELECT o_custkey, string_agg('S.A' || o_orderkey, ',' ORDER BY 'A' || o_orderkey) AS sections FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1),
    f AS (SELECT o_custkey, string_agg('F' || o_orderkey, ',' ORDER BY 'F' || o_orderkey) AS forms FROM orders WHERE o_orderkey % 10 = 0 GROUP BY 1)
    SELECT 'Справочник.C' || c_custkey AS object, c_mktsegment AS kind, coalesce(attributes, '') AS attributes, coalesce(n, 0) AS n_attributes, coalesce(sections, '') AS sections, coalesce(forms, '') AS forms, CASE WHEN c_custkey % 4 = 0 THEN 'ext' ELSE '' END AS others
    FROM customer LEFT JOIN l ON l.o_custkey = c_custkey LEFT JOIN s ON s.o_custkey = c_custkey LEFT JOIN f ON f.o_custkey = c_custkey""")
def object_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    name = lambda k: F.concat(F.lit("Справочник.C"), k)
    main = c.select(name("c_custkey").alias("object"), F.lit("main").alias("source_id"), F.col("c_mktsegment").alias("kind"), F.col("c_name").alias("synonym"), F.lit("").alias("comment"), "c_custkey")
    known = main.unionByName(main.filter("c_custkey % 4 = 0").withColumn("source_id", F.lit("ext"))).drop("c_custkey")
    inner = F.col("o_orderkey") % 5 == 0
    attributes = o.select(name("o_custkey").alias("object"), F.lit("main").alias("source_id"), F.when(inner, F.concat(F.lit("S.A"), "o_orderkey")).otherwise(F.concat(F.lit("A"), "o_orderkey")).alias("attribute"), F.lit("Реквизит").alias("kind"), F.col("o_orderpriority").alias("type_desc"))
    forms = o.filter("o_orderkey % 10 = 0").select(name("o_custkey").alias("object"), F.lit("main").alias("source_id"), F.concat(F.lit("F"), "o_orderkey").alias("form"))
    no = known.limit(0)
    rows = objects.pages(known, attributes, forms, no.select("object", F.lit("").alias("key"), F.lit("").alias("value")), no.select("object", "source_id", F.lit("").alias("member")), main_source="main")
    text = lambda c, f: F.coalesce(F.array_join(F.transform(c, f), ","), F.lit(""))
    sections = F.flatten(F.transform("sections", lambda s: F.transform(s["attributes"], lambda a: F.concat_ws(".", s["section"], a["attribute"]))))
    return rows.select("object", "kind", text("attributes", lambda a: F.concat_ws(":", a["attribute"], a["type_desc"])).alias("attributes"), F.col("n_attributes").cast("long").alias("n_attributes"), F.coalesce(F.array_join(sections, ","), F.lit("")).alias("sections"), text("forms", lambda f: f).alias("forms"), F.array_join("other_sources", ",").alias("others"))


@entry("""
    WITH RECURSIVE up AS (SELECT p_partkey AS id, p_partkey // 3 AS parent, [p_name] AS path, 1 AS n FROM part UNION ALL SELECT up.id, p.p_partkey // 3, [p.p_name] || up.path, n + 1 FROM up JOIN part p ON p.p_partkey = up.parent WHERE up.parent > 0 AND n < 50)
    SELECT id, array_to_string(arg_max(path, n), ' / ') AS path FROM up GROUP BY 1""")
def section_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 3).cast("long").alias("up"), F.col("p_name").alias("title"))
    rows = rows.withColumn("parent", F.when(F.col("up") > 0, F.col("up")))
    return objects.parent_paths(rows).select("id", F.array_join("path", " / ").alias("path"))


# -- reports --------------------------------------------------------------------------------------------------------------

REPORT = "v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_tax = 0 THEN 'error' WHEN l_tax < 0.04 THEN 'warning' END AS level FROM lineitem WHERE l_tax < 0.04)"


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").filter("l_tax < 0.04")
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    rows = rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.lit("main").alias("source_id"), F.col("l_orderkey").alias("module"), place.alias("place"), F.when(F.col("l_tax") == 0, "error").otherwise("warning").alias("level"))
    order = Window.partitionBy("level", "module").orderBy("place")
    # Positions as a report has them: within a module, after the modules before it.
    sizes = rows.groupBy("level", "module").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("level").orderBy("module")) - F.col("n"))
    return rows.join(sizes.drop("n"), ["level", "module"]).withColumn("pos", F.row_number().over(order) + F.col("before") - 1)


@entry(f"WITH {REPORT} SELECT l.level, count(v.level) AS n FROM (VALUES ('error'), ('warning'), ('unchecked')) AS l(level) LEFT JOIN v ON v.level = l.level GROUP BY 1")
def report_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.level_counts(_verdicts(spark, sf_dir))


@entry(f"WITH {REPORT} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, level FROM v ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 40 OFFSET 120")
def report_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.page(_verdicts(spark, sf_dir), ["error", "warning"], 40, 120).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "level")


@entry("SELECT p_partkey, (p_partkey & 63) <> 0 AND (p_partkey & 960) = 0 AS client_only, p_partkey & ~(p_size::BIGINT) & 1023 AS remaining FROM part")
def target_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = F.col("p_partkey")
    return read(spark, sf_dir, "part").select("p_partkey", verdicts.client_only(mask).alias("client_only"), verdicts.remaining(mask, F.col("p_size").cast("long")).alias("remaining"))


@entry("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS indexed_at, o_orderdate > TIMESTAMP '1995-06-01' AS later FROM orders")
def indexed_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as the index writes them, and compared."""
    at = F.col("o_orderdate")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("indexed_at"), (at > F.lit("1995-06-01").cast("timestamp_ntz")).alias("later"))


# -- names of kinds -------------------------------------------------------------------------------------------------------

KIND_ALIASES = {"machines": "MACHINERY", "machinery": "MACHINERY", "house": "HOUSEHOLD"}


@entry("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment = 'MACHINERY'")
def kind_alias_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.of_kind(read(spark, sf_dir, "customer"), "c_mktsegment", "Machines", KIND_ALIASES).select("c_custkey", "c_name", "c_mktsegment")
