"""The query catalogue over the test tables, each entry with the SQL that states its result.

Roles: ``part`` holds procedures (brand = module), ``lineitem`` calls (a part calls the next one of its order),
``customer`` and ``supplier`` objects, ``orders`` their versions, ``documents`` module text, ``pages`` help.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import source_code
from quarry.functions import text as T
from quarry.operators import diff, graph, metrics, search
from quarry.plans.registry import ORACLE_SQL, QUERIES, entry, read

__all__ = ["ORACLE_SQL", "QUERIES"]


# -- search over names ------------------------------------------------------------------------------------------------


@entry("SELECT p_partkey, p_name, p_brand, lower(p_name) = 'ring' AS exact FROM part WHERE contains(lower(p_name), 'ring') ORDER BY exact DESC, length(p_name), p_name, p_partkey LIMIT 30")
def search_substring_exact_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    return search.page(search.exact_first(part, "p_name", "ring", "p_partkey"), 30)


@entry("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red') AND contains(lower(p_name), 'wid')")
def search_multiword_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").filter(search.contains_all(F.col("p_name"), ["Red", "wid"])).select("p_partkey", "p_name")


@entry("""
    WITH t AS (SELECT p_partkey, p_brand, CASE WHEN lower(p_brand) = 'brand#1x' THEN 0 WHEN lower(p_brand) LIKE 'brand#1%' THEN 1 WHEN contains(lower(p_brand), '1') THEN 2 END AS tier FROM part)
    SELECT p_partkey, p_brand, tier FROM t WHERE tier = (SELECT min(tier) FROM t)""")
def resolve_best_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.lower("p_brand")
    return search.best_tier(read(spark, sf_dir, "part").select("p_partkey", "p_brand"), [name == "brand#1x", name.startswith("brand#1"), name.contains("1")]).select("p_partkey", "p_brand", "tier")


@entry("""
    WITH v AS (SELECT unnest(range(0, 5)) AS tier, unnest(['ringer', 'ringe', 'ring', 'rin', 'ri']) AS prefix),
         t AS (SELECT p_partkey, p_name, prefix, tier FROM part, v WHERE contains(lower(p_name), prefix))
    SELECT p_partkey, p_name, prefix FROM t WHERE tier = (SELECT min(tier) FROM t)""")
def prefix_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.prefix_fallback(read(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "ringer").select("p_partkey", "p_name", "prefix")


@entry("SELECT c_custkey, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 ORDER BY c_name, c_custkey LIMIT 21 OFFSET 20")
def list_objects_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return search.page(read(spark, sf_dir, "customer").join(nation, "c_nationkey", "left_semi").orderBy("c_name", "c_custkey").select("c_custkey", "c_name"), 21, 20)


@entry("SELECT c_custkey, n_name AS source_label, r_name AS region_label, CASE WHEN r_regionkey % 2 = 0 THEN 'main' ELSE 'extension' END AS source_type FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def source_label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    kind = F.when(F.col("r_regionkey") % 2 == 0, "main").otherwise("extension")
    out = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    return out.select("c_custkey", F.col("n_name").alias("source_label"), F.col("r_name").alias("region_label"), kind.alias("source_type"))


@entry("SELECT c_mktsegment AS kind, count(*) AS n, min(c_custkey) AS first_key FROM customer GROUP BY 1")
def counts_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("first_key"))


# -- calls ------------------------------------------------------------------------------------------------------------

CALLS_SQL = """calls AS (
    SELECT l_orderkey AS order_id, l_linenumber AS line, l_partkey AS caller, l_suppkey AS module, l_returnflag AS kind, l_quantity AS qty, l_extendedprice AS price,
           lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS callee
    FROM lineitem)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part calls the next part of its order; the last one's call has no target."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("caller"), F.col("l_suppkey").alias("module"), F.col("l_returnflag").alias("kind"),
        F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), F.lead("l_partkey").over(order).alias("callee"),
    )


@entry(f"WITH {CALLS_SQL} SELECT caller, count(*) AS sites, min(line) AS first_line FROM calls WHERE callee IN (SELECT p_partkey FROM part WHERE p_name = 'red widget') GROUP BY 1")
def callers_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = read(spark, sf_dir, "part").filter("p_name = 'red widget'").select(F.col("p_partkey").alias("callee"))
    return calls(spark, sf_dir).join(wanted, "callee", "left_semi").groupBy("caller").agg(F.count(F.lit(1)).alias("sites"), F.min("line").alias("first_line"))


@entry(f"WITH {CALLS_SQL} SELECT p_name AS callee_name, count(*) AS sites, min(line) AS first_line FROM calls JOIN part ON callee = p_partkey WHERE caller IN (SELECT p_partkey FROM part WHERE p_name = 'red widget') GROUP BY 1")
def callees_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    wanted = part.filter("p_name = 'red widget'").select(F.col("p_partkey").alias("caller"))
    found = calls(spark, sf_dir).join(wanted, "caller", "left_semi").join(part.select(F.col("p_partkey").alias("callee"), F.col("p_name").alias("callee_name")), "callee")
    return found.groupBy("callee_name").agg(F.count(F.lit(1)).alias("sites"), F.min("line").alias("first_line"))


@entry(f"WITH {CALLS_SQL} SELECT kind, count(*) AS total, count(callee) AS resolved, round(100.0 * count(callee) / count(*), 1) AS pct FROM calls GROUP BY 1")
def resolution_ratio_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.resolution(calls(spark, sf_dir), "kind", "callee")


@entry(f"WITH {CALLS_SQL} SELECT module, count(*) AS total, count(callee) AS resolved, round(100.0 * count(callee) / count(*), 1) AS pct FROM calls GROUP BY 1 HAVING count(*) >= 5 ORDER BY pct, total DESC, module LIMIT 20")
def worst_modules_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.worst(metrics.resolution(calls(spark, sf_dir), "module", "callee"), "module", 5, 20)


@entry(f"WITH {CALLS_SQL} SELECT p_name AS name, p_brand AS brand, count(*) AS n FROM calls JOIN part ON caller = p_partkey WHERE callee IS NULL GROUP BY 1, 2 ORDER BY n DESC, name, brand LIMIT 20")
def top_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("caller"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    return calls(spark, sf_dir).filter("callee is null").join(part, "caller").groupBy("name", "brand").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name", "brand").limit(20)


@entry(f"""
    WITH {CALLS_SQL}
    SELECT module, count(*) AS calls, count(DISTINCT callee) AS methods, count(DISTINCT caller) AS callers, min(line * 10000000 + order_id) AS first_site FROM calls GROUP BY 1""")
def external_modules_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.min(F.col("line").cast("long") * 10_000_000 + F.col("order_id"))
    return calls(spark, sf_dir).groupBy("module").agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("callee").alias("methods"), F.countDistinct("caller").alias("callers"), first.alias("first_site"))


def _tree(spark: SparkSession, sf_dir: str, up: bool) -> DataFrame:
    ends = ("callee", "caller") if up else ("caller", "callee")
    edges = calls(spark, sf_dir).filter("callee is not null").select(F.col(ends[0]).alias("src"), F.col(ends[1]).alias("dst")).distinct()
    return graph.traverse(edges, spark.range(3, 5).select(F.col("id").alias("node")), 2)


TREE_SQL = """
    WITH RECURSIVE {calls}, edges AS (SELECT DISTINCT {src} AS src, {dst} AS dst FROM calls WHERE callee IS NOT NULL),
    walk AS (SELECT unnest([3, 4])::BIGINT AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM walk JOIN edges ON src = node WHERE depth < 2)
    SELECT node, min(depth) AS depth FROM walk GROUP BY 1"""


@entry(TREE_SQL.format(calls=CALLS_SQL, src="caller", dst="callee"))
def call_tree_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir, False)


@entry(TREE_SQL.format(calls=CALLS_SQL, src="callee", dst="caller"))
def call_tree_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir, True)


# -- lines ---------------------------------------------------------------------------------------------------------------

@entry("""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS line, string_split(text, chr(10)) AS lines FROM documents),
    h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS rn, count(*) OVER (PARTITION BY doc_id) AS n FROM l WHERE contains(lower(s), 'ring'))
    SELECT doc_id, CAST(line AS INTEGER) AS line, array_to_string(lines[greatest(line - 1, 1):line + 1], chr(10)) AS context, n > 5 AS capped FROM h WHERE rn <= 5""")
def code_search_context_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.matching_lines(read(spark, sf_dir, "documents"), "doc_id", "text", "ring", 5)


# -- snapshots --------------------------------------------------------------------------------------------------------

EVENTS_SQL = """v AS (SELECT user_id, event_type, ts, value, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events {})"""


@entry(f"WITH {EVENTS_SQL.format('')} SELECT user_id, event_type, event_id, value FROM v WHERE rn = 1")
def latest_state_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    keys, order = ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]
    half = F.lit("2024-01-08").cast("timestamp_ntz")
    changes = diff.latest(rows.filter(F.col("ts") >= half), keys, order)
    return diff.upsert(diff.latest(rows.filter(F.col("ts") < half), keys, order), changes, keys).select("user_id", "event_type", "event_id", "value")


# -- objects and texts ------------------------------------------------------------------------------------------------


@entry(r"""
    WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style|head)\b.*?</(script|style|head)>', ' ', 'g') AS t FROM pages),
    b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)<br\s*/?>|</(p|div|li|tr|h[1-6]|table|ul|ol)>', chr(10), 'g'), '(?s)<[^>]*>', '', 'g') AS t FROM a)
    SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') AS body FROM b""")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("body"))


@entry("""
    WITH a AS (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS t FROM pages)
    SELECT page_id, replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&') AS title FROM a""")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", T.unescape_marks(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)).alias("title"))


# -- module texts -----------------------------------------------------------------------------------------------------


def _modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module for each part: a function that calls the part's namesake, and a procedure that calls the function."""
    part = read(spark, sf_dir, "part")
    text = F.concat(F.lit("#Region Public\nFunction F"), "p_partkey", F.lit("(A) Export\n"), F.repeat(F.lit("  // Nothing(A)\n"), F.col("p_size")), F.lit('  Return Store.Find("G(1)", A);\nEndFunction\n#EndRegion\n\nProcedure Main()\n  F'), "p_partkey", F.lit("(1);\nEndProcedure\n"))
    return part.select("p_partkey", text.alias("text"))


@entry("""
    SELECT p_partkey, 'F' || p_partkey AS name, 'function' AS kind, true AS is_export, 2 AS start_line, p_size + 4 AS end_line, 'Public' AS region FROM part
    UNION ALL SELECT p_partkey, 'Main', 'procedure', false, p_size + 7, p_size + 9, '' FROM part""")
def module_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source_code.procedures_of(_modules(spark, sf_dir), "p_partkey", "text")
    return rows.select("p_partkey", "name", "kind", "is_export", "start_line", "end_line", "region")


@entry("""
    SELECT p_partkey, 'F' || p_partkey AS caller, p_size + 3 AS line, 'Store' AS owner, 'Find' AS callee FROM part
    UNION ALL SELECT p_partkey, 'Main', p_size + 8, '', 'F' || p_partkey FROM part""")
def module_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_code.calls_of(_modules(spark, sf_dir), "p_partkey", "text")


@entry("""
    WITH p AS (SELECT o.p_partkey, o.p_name AS a, CASE WHEN o.p_partkey % 5 > 0 THEN n.p_name END AS b FROM part o LEFT JOIN part n ON n.p_partkey = o.p_partkey + 1)
    SELECT p_partkey, CASE WHEN b IS NULL THEN 'removed' WHEN a = b THEN 'same' ELSE 'changed' END AS status,
        CASE WHEN a = b THEN '' WHEN b IS NULL THEN '--- old' || chr(10) || '+++ new' || chr(10) || '@@ -1 +0,0 @@' || chr(10) || '-' || a
        ELSE '--- old' || chr(10) || '+++ new' || chr(10) || '@@ -1 +1 @@' || chr(10) || '-' || a || chr(10) || '+' || b END AS diff FROM p""")
def text_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    rows = part.join(part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next")), "p_partkey", "left")
    new = F.when(F.col("p_partkey") % 5 > 0, F.col("next"))
    return rows.select("p_partkey", diff.text_status(F.col("p_name"), new).alias("status"), diff.unified_diff("p_name", new).alias("diff"))
