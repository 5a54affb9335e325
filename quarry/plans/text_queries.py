"""Queries over texts and names: tokens, ranks, cascades, cards, glossaries, pieces of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import cards, glossary, metadata_search, metrics, search
from quarry.plans.registry import entry, read

TOKENS_SQL = r"""toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '([\p{L}\p{N}_]+)', 1)) AS token FROM documents),
    post AS (SELECT doc_id, token, count(*) AS tf FROM toks GROUP BY 1, 2), len AS (SELECT doc_id, sum(tf) AS len FROM post GROUP BY 1)"""
BM25_SQL = (
    TOKENS_SQL
    + """, terms AS (SELECT unnest(['tion', 'ring', 'wor']) AS term),
    f AS (SELECT doc_id, term, sum(tf) AS f FROM post JOIN terms ON starts_with(token, term) GROUP BY 1, 2), n AS (SELECT term, count(*) AS n FROM f GROUP BY 1),
    k AS (SELECT count(*) AS total, avg(len) AS mean FROM len),
    scored AS (SELECT doc_id, sum(greatest(ln((total - n + 0.5) / (n + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / mean))) AS score FROM f JOIN n USING (term) JOIN len USING (doc_id), k GROUP BY 1)"""
)
TERMS = ["tion", "ring", "wor"]


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.postings(read(spark, sf_dir, "documents"), "doc_id", {"text": "text"})


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.scan_bm25(read(spark, sf_dir, "documents"), "doc_id", {"text": "text"}, TERMS, {"text": 1.0})


@entry(f"WITH {TOKENS_SQL} SELECT token, count(*) AS df FROM post GROUP BY 1")
def tokens_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.document_frequencies(read(spark, sf_dir, "documents"), "text")


@entry(f"WITH {TOKENS_SQL} SELECT token, count(*) AS documents, CAST(sum(tf) AS BIGINT) AS occurrences, CAST(max(tf) AS BIGINT) AS most FROM post GROUP BY 1")
def postings_by_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _postings(spark, sf_dir).groupBy("token").agg(F.count(F.lit(1)).alias("documents"), F.sum("tf").alias("occurrences"), F.max("tf").alias("most"))


@entry(f"WITH {TOKENS_SQL}, terms AS (SELECT unnest(['er', 'an']) AS term) SELECT doc_id, CAST(sum(tf) AS BIGINT) AS hits FROM post JOIN terms ON starts_with(token, term) GROUP BY 1 HAVING count(DISTINCT term) = 2 ORDER BY hits DESC, doc_id LIMIT 200")
def fts_and_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.scan_all(read(spark, sf_dir, "documents"), "doc_id", {"text": "text"}, T.query_tokens("Er an")).limit(200)


@entry(f"WITH {BM25_SQL} SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY round(score, 6) DESC, doc_id LIMIT 50")
def bm25_prefix_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(50)


WEIGHTED_SQL = r"""toks AS (SELECT p_partkey, 'name' AS field, unnest(regexp_extract_all(lower(p_name), '([\p{L}\p{N}_]+)', 1)) AS token FROM part
                  UNION ALL SELECT p_partkey, 'type', unnest(regexp_extract_all(lower(p_type), '([\p{L}\p{N}_]+)', 1)) FROM part),
    len AS (SELECT p_partkey, count(*) AS len FROM toks GROUP BY 1), terms AS (SELECT unnest(['red', 'pro', 'small']) AS term),
    f AS (SELECT p_partkey, term, sum(CASE field WHEN 'name' THEN 10.0 ELSE 2.0 END) AS f FROM toks JOIN terms ON starts_with(token, term) GROUP BY 1, 2), n AS (SELECT term, count(*) AS n FROM f GROUP BY 1),
    k AS (SELECT count(*) AS total, avg(len) AS mean FROM len)"""


@entry(f"""
    WITH {WEIGHTED_SQL} SELECT p_partkey, round(sum(greatest(ln((total - n + 0.5) / (n + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score
    FROM f JOIN n USING (term) JOIN len USING (p_partkey), k GROUP BY 1""")
def bm25_weighted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the index: postings, lengths, and the hits of the terms' ranges."""
    post = search.postings(read(spark, sf_dir, "part"), "p_partkey", {"name": "p_name", "type": "p_type"})
    scored = search.bm25_terms(post, search.lengths(post, "p_partkey"), "p_partkey", ["red", "pro", "small"], {"name": 10.0, "type": 2.0})
    return scored.select("p_partkey", F.round("score", 6).alias("score"))


PRUNED = ["the", "tion", "ring", "wor", "a", "zzzz"]


@entry(f"""
    WITH {TOKENS_SQL}, terms AS (SELECT unnest({PRUNED}) AS term, unnest(range({len(PRUNED)})) AS i), v AS (SELECT token, count(*) AS df FROM post GROUP BY 1),
    d AS (SELECT term, i, CAST(coalesce(sum(df), 0) AS BIGINT) AS df FROM terms LEFT JOIN v ON starts_with(token, term) GROUP BY 1, 2), r AS (SELECT *, least(1.0, df / (SELECT count(*) FROM documents)) AS share FROM d),
    k AS (SELECT *, row_number() OVER (ORDER BY share, i) AS rarity FROM r) SELECT term, df, share <= 0.5 AS rare, share <= 0.5 OR rarity <= 2 AND (SELECT count(*) FROM r WHERE share <= 0.5) < 2 AS kept FROM k""")
def common_term_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    vocab, total = search.document_frequencies(docs, "text"), docs.count()
    kept = cards.rare_terms(vocab, total, PRUNED)
    df = search.expand_prefixes(vocab, PRUNED).join(vocab, "token").groupBy("term").agg(F.sum("df").alias("df"))
    rows = spark.createDataFrame([(t,) for t in PRUNED], "term string").join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0).cast("long")))
    return rows.select("term", "df", (F.col("df") * 2 <= total).alias("rare"), F.col("term").isin(kept).alias("kept"))


@entry(f"""
    WITH {BM25_SQL}, cand AS (
        SELECT doc_id, 0 AS tier, doc_id::DOUBLE AS pos FROM documents WHERE source = 'src3' AND contains(lower(text), 'tion')
        UNION ALL SELECT doc_id, 1, length(text)::DOUBLE FROM documents WHERE contains(lower(text), 'tion') AND contains(lower(text), 'ring')
        UNION ALL SELECT doc_id, 2, -round(score, 6) FROM scored), m AS (SELECT doc_id, min(tier) AS tier FROM cand GROUP BY 1)
    SELECT m.doc_id, m.tier, min(pos) AS pos FROM m JOIN cand c ON m.doc_id = c.doc_id AND m.tier = c.tier GROUP BY 1, 2 ORDER BY tier, pos, doc_id LIMIT 200""")
def search_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    exact = docs.filter(F.col("source") == "src3").filter(search.contains_all(F.col("text"), ["tion"])).select("doc_id", F.col("doc_id").alias("pos"))
    both = docs.filter(search.contains_all(F.col("text"), ["tion", "ring"])).select("doc_id", F.length("text").alias("pos"))
    ranked = _scored(spark, sf_dir).select("doc_id", (-F.round("score", 6)).alias("pos"))
    return search.cascade([exact, both, ranked], "doc_id").orderBy("tier", "pos", "doc_id").limit(200)


@entry(f"""
    WITH {TOKENS_SQL}, q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '([\\p{{L}}\\p{{N}}_]{{9,}})', 1))) AS token FROM benchmark),
    s AS (SELECT item_id, doc_id, count(*) AS shared FROM q JOIN post USING (token) GROUP BY 1, 2),
    r AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id) AS rank FROM s),
    t AS (SELECT b.item_id, min(r.rank) FILTER (l.quality = 1) AS rank FROM benchmark b LEFT JOIN r ON b.item_id = r.item_id LEFT JOIN labels l ON r.doc_id = l.doc_id GROUP BY 1)
    SELECT count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS hit1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS hit5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS hit10, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM t""")
def eval_hit_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "benchmark")
    q = items.select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]{9,})"), F.lit(1)))).alias("token"))
    # Only words as long as those of the questions are taken out of the texts.
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]{9,})"), F.lit(1)))).alias("token")
    shared = q.join(read(spark, sf_dir, "documents").select("doc_id", words), "token").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("shared"))
    ranked = shared.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("shared"), "doc_id")))
    good = ranked.join(read(spark, sf_dir, "labels").filter("quality = 1").select("doc_id"), "doc_id", "left_semi").groupBy("item_id").agg(F.min("rank").alias("rank"))
    return metrics.retrieval(items.select("item_id").join(good, "item_id", "left"), "rank")


# -- objects, attributes, cards -------------------------------------------------------------------------------------------


def _scores(table: str, key: str, fields: dict[str, tuple[str, float]], terms: list[str], name: str, pool: int) -> str:
    """SQL of the ``pool`` best rows of a table by weighted BM25: key and score, negative."""
    toks = " UNION ALL ".join(f"SELECT {key}, '{f}' AS field, unnest(regexp_extract_all(lower(coalesce({c}, '')), '([\\p{{L}}\\p{{N}}_]+)', 1)) AS token FROM {table}" for f, (c, _) in fields.items())
    weight = " ".join(f"WHEN '{f}' THEN {w}" for f, (_, w) in fields.items())
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""{name}_t AS ({toks}), {name}_l AS (SELECT {key}, count(*) AS len FROM {name}_t GROUP BY ALL), {name}_q AS (SELECT unnest([{listed}]) AS term),
    {name}_f AS (SELECT {key}, term, sum(CASE field {weight} END) AS f FROM {name}_t JOIN {name}_q ON starts_with(token, term) GROUP BY ALL), {name}_n AS (SELECT term, count(*) AS n FROM {name}_f GROUP BY 1),
    {name}_k AS (SELECT count(*) AS total, avg(len) AS mean FROM {name}_l),
    {name} AS (SELECT {key}, -sum(greatest(ln((total - n + 0.5) / (n + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / mean))) AS score FROM {name}_f JOIN {name}_n USING (term) JOIN {name}_l USING ({key}), {name}_k GROUP BY ALL ORDER BY score, {key} LIMIT {pool})"""


OBJECTS_SQL = """objects AS (SELECT 'Kind.' || replace(p_name, ' ', '') || p_partkey AS object, p_type AS kind, replace(p_name, ' ', '') || p_partkey AS name, p_name AS synonym, CASE WHEN p_size > 30 THEN 'big ' || p_brand ELSE '' END AS comment FROM part),
    attributes AS (SELECT 'Kind.' || replace(p_name, ' ', '') || p_partkey AS object, 'A' || l_orderkey || '_' || l_linenumber || '_' || l_suppkey AS attribute, CASE l_returnflag WHEN 'A' THEN 'gear wheel' WHEN 'N' THEN 'plate' ELSE 'red pin' END AS synonym, 'Number(' || l_linenumber || ')' AS type_desc, l_linestatus AS comment
        FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity < 3)"""
DATA = ("ECONOMY", "SMALL")


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = read(spark, sf_dir, "part")
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("")), "p_partkey")
    big = F.when(F.col("p_size") > 30, F.concat(F.lit("big "), "p_brand")).otherwise("")
    known = part.select(F.concat(F.lit("Kind."), name).alias("object"), F.lit("main").alias("source_id"), F.col("p_type").alias("kind"), name.alias("name"), F.col("p_name").alias("synonym"), big.alias("comment"), "p_partkey")
    flag = F.when(F.col("l_returnflag") == "A", "gear wheel").when(F.col("l_returnflag") == "N", "plate").otherwise("red pin")
    lines = read(spark, sf_dir, "lineitem").filter("l_quantity < 3").withColumnRenamed("l_partkey", "p_partkey")
    attributes = lines.join(known.select("p_partkey", "object", "source_id"), "p_partkey").select(
        "object", "source_id", F.concat(F.lit("A"), "l_orderkey", F.lit("_"), "l_linenumber", F.lit("_"), "l_suppkey").alias("attribute"), flag.alias("synonym"),
        F.concat(F.lit("Number("), "l_linenumber", F.lit(")")).alias("type_desc"), F.col("l_linestatus").alias("comment"), F.lit("").alias("kind"),
    )
    return known.drop("p_partkey"), attributes


_OBJECT_FIELDS = {f: (f, w) for f, w in metadata_search.OBJECT_WEIGHTS.items()}
_ATTRIBUTE_FIELDS = {f: (f, w) for f, w in metadata_search.ATTRIBUTE_WEIGHTS.items()}
RANKED_SQL = f"""{OBJECTS_SQL}, {_scores("objects", "object", _OBJECT_FIELDS, ["red", "gear"], "own", 200)}, {_scores("attributes", "object, attribute", _ATTRIBUTE_FIELDS, ["red", "gear"], "pool", 400)},
    best AS (SELECT object, min(score) AS best FROM pool GROUP BY 1), named AS (SELECT object FROM objects WHERE contains(lower(name), 'red') AND contains(lower(name), 'gear') ORDER BY object LIMIT 200),
    found AS (SELECT object FROM own UNION SELECT object FROM best UNION SELECT object FROM named),
    ranked AS (SELECT object, (coalesce(own.score, 0) + 0.5 * coalesce(best, 0) + CASE WHEN object IN (SELECT object FROM named) THEN -12 ELSE 0 END) * CASE WHEN kind IN ('ECONOMY', 'SMALL') THEN 1.3 ELSE 1.0 END AS score
        FROM found JOIN objects USING (object) LEFT JOIN own USING (object) LEFT JOIN best USING (object))"""


@entry(f"WITH {RANKED_SQL} SELECT object, round(score, 5) AS rank FROM ranked")
def rank_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, attributes = _index(spark, sf_dir)
    return metadata_search.ranked_objects(known, attributes, None, "red gear", DATA).select("object", F.round("score", 5).alias("rank"))


@entry(f"""
    WITH {OBJECTS_SQL}, t AS (SELECT object, 0 AS tier FROM objects WHERE lower(synonym) = 'red widget' UNION ALL SELECT object, 2 FROM (SELECT object FROM objects WHERE contains(lower(name), 'red') AND contains(lower(name), 'widget') ORDER BY object LIMIT 200))
    SELECT object, min(tier) AS tier FROM t GROUP BY 1""")
def search_objects_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first tiers of the cascade: every object that the query names or that is called by it."""
    known, _ = _index(spark, sf_dir)
    return metadata_search.search_objects(known, "Red widget", limit=100_000, kinds=DATA).filter("tier in (0, 2)").select("object", "tier")


@entry(f"""
    WITH {OBJECTS_SQL}, {_scores("objects", "object", _OBJECT_FIELDS, ["pin"], "own", 200)}, {_scores("attributes", "object, attribute", _ATTRIBUTE_FIELDS, ["pin"], "pool", 400)}
    SELECT object, attribute, round((pool.score + 0.5 * coalesce(own.score, 0)) * CASE WHEN kind IN ('ECONOMY', 'SMALL') THEN 1.3 ELSE 1.0 END, 5) AS score FROM pool JOIN objects USING (object) LEFT JOIN own USING (object)""")
def rank_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, attributes = _index(spark, sf_dir)
    return metadata_search.ranked_attributes(known, attributes, "pin", DATA).select("object", "attribute", F.round("score", 5).alias("score"))


CARDS_SQL = f"""chunks AS (SELECT p_partkey, p_name AS head, p_type || ' ' || p_brand AS body, p_size > 25 AS is_export FROM part),
    callers AS (SELECT l_suppkey AS p_partkey, count(*) AS callers FROM lineitem GROUP BY 1),
    {_scores("chunks", "p_partkey", {"head": ("head", 8.0), "body": ("body", 1.0)}, ["red", "economy"], "raw", 100000)},
    pool AS (SELECT p_partkey, score * (1 + 0.15 * CASE WHEN is_export THEN 1 ELSE 0 END) AS s FROM raw JOIN chunks USING (p_partkey) ORDER BY s, p_partkey LIMIT 200),
    ranked AS (SELECT p_partkey, s * (1 + 0.03 * ln(1 + coalesce(callers, 0))) AS score FROM pool LEFT JOIN callers USING (p_partkey))"""


@entry(f"WITH {CARDS_SQL} SELECT p_partkey AS proc_id, round(score, 4) AS score, CAST(row_number() OVER (ORDER BY score, p_partkey) AS INTEGER) AS rank FROM ranked ORDER BY rank LIMIT 40")
def rank_popularity_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card search: weighted BM25, more by export and by callers, the best chunk of each procedure."""
    part = read(spark, sf_dir, "part")
    chunks = part.select(F.struct(F.col("p_partkey").alias("proc_id"), F.lit(0).alias("chunk_no")).alias("chunk"), F.col("p_name").alias("head"), F.concat_ws(" ", "p_type", "p_brand").alias("body"))
    post = search.postings(chunks, "chunk", {"head": "head", "body": "body"})
    procedures = part.select(F.col("p_partkey").alias("proc_id"), F.col("p_name").alias("procedure"), F.col("p_brand").alias("module"), (F.col("p_size") > 25).alias("is_export"))
    callers = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("proc_id")).agg(F.count(F.lit(1)).alias("callers"))
    found = cards.search_cards(post, chunks, procedures, callers, "red economy", ["red", "economy"], limit=40)
    return found.select("proc_id", F.round("score", 4).alias("score"), "rank")


# -- glossary -------------------------------------------------------------------------------------------------------------

GLOSSARY_SQL = """glossary AS (SELECT p_partkey AS id, p_name AS target, [lower(split_part(p_name, ' ', 2)) || ' ' || lower(p_type), lower(p_brand)] AS terms FROM part WHERE p_partkey % 3 = 0)"""


@entry(f"WITH {GLOSSARY_SQL}, t AS (SELECT id, target, unnest(terms) AS term FROM glossary) SELECT id, target, max(term) AS term, 2 AS score FROM t WHERE term IN ('ring economy', 'ring small') GROUP BY 1, 2")
def glossary_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").filter("p_partkey % 3 = 0")
    terms = F.array(F.concat_ws(" ", F.lower(F.split_part("p_name", F.lit(" "), F.lit(2))), F.lower("p_type")), F.lower("p_brand"))
    rows = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("target"), F.lit("object").alias("target_kind"), terms.alias("terms"))
    return glossary.matches(rows, "where are the small economy ring").select("id", "target", "term", "score")


@entry("""
    WITH t AS (SELECT DISTINCT CASE o_orderkey % 4 WHEN 0 THEN 'Catalog.C' || o_custkey WHEN 1 THEN 'Mod' || o_custkey % 5 || '.Proc' || o_custkey % 7 WHEN 2 THEN 'Catalog.C' || o_custkey % 9 || '.Attr' || o_custkey % 4 ELSE 'Nothing.N' || o_custkey END AS target FROM orders),
    o AS (SELECT 'Catalog.C' || c_custkey AS full_name FROM customer), p AS (SELECT DISTINCT 'Mod' || c_custkey % 4 || '.Proc' || c_custkey % 6 AS full_name FROM customer), a AS (SELECT DISTINCT 'Catalog.C' || c_custkey % 8 || '.Attr' || c_custkey % 3 AS full_name FROM customer)
    SELECT target, target AS full_name, CASE WHEN target IN (SELECT full_name FROM o) THEN 'object' WHEN target IN (SELECT full_name FROM p) THEN 'procedure' ELSE 'attribute' END AS target_kind FROM t
    WHERE target IN (SELECT full_name FROM o UNION SELECT full_name FROM p UNION SELECT full_name FROM a)""")
def glossary_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    k, n = F.col("o_custkey"), F.col("o_orderkey") % 4
    target = F.when(n == 0, F.concat(F.lit("Catalog.C"), k)).when(n == 1, F.concat(F.lit("Mod"), k % 5, F.lit(".Proc"), k % 7)).when(n == 2, F.concat(F.lit("Catalog.C"), k % 9, F.lit(".Attr"), k % 4)).otherwise(F.concat(F.lit("Nothing.N"), k))
    key = F.col("c_custkey")
    known = c.select(F.concat(F.lit("Catalog.C"), key).alias("object"))
    procs = c.select(F.concat(F.lit("Mod"), key % 4).alias("module"), F.concat(F.lit("Proc"), key % 6).alias("procedure")).distinct()
    attrs = c.select(F.concat(F.lit("Catalog.C"), key % 8).alias("object"), F.concat(F.lit("Attr"), key % 3).alias("attribute")).distinct()
    return glossary.resolve_targets(o.select(target.alias("target")), known, procs, attrs)


# -- pieces of text -------------------------------------------------------------------------------------------------------


@entry("""
    WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
    q AS (SELECT doc_id, line, unnest(range(0, greatest(length(s), 1), 400)) AS place, length(s) AS n FROM l), p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line, place) AS i, least(n - place, 400) + 1 AS n FROM q),
    walk AS (SELECT doc_id, i, n AS size, 1 AS piece FROM p WHERE i = 1 UNION ALL SELECT p.doc_id, p.i, CASE WHEN size + p.n > 400 THEN p.n ELSE size + p.n END, CASE WHEN size + p.n > 400 THEN piece + 1 ELSE piece END FROM walk JOIN p ON p.doc_id = walk.doc_id AND p.i = walk.i + 1),
    c AS (SELECT doc_id, piece, max(size) AS size FROM walk GROUP BY 1, 2)
    SELECT doc_id, CAST(count(*) AS INTEGER) AS chunks, CAST(max(size) AS INTEGER) AS longest FROM c GROUP BY 1""")
def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = T.chunk_lines(F.split("text", "\n", -1), 400)
    rows = read(spark, sf_dir, "documents").select("doc_id", pieces.alias("pieces"))
    return rows.select("doc_id", F.size("pieces").alias("chunks"), F.array_max(F.transform("pieces", lambda p: p["chars"])).alias("longest"))


@entry(r"""
    WITH n AS (SELECT s_suppkey, s_name || 'XMLPackage2ReadUTF' || s_nationkey AS name FROM supplier),
    s AS (SELECT s_suppkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([a-z])([A-Z])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g') AS name FROM n)
    SELECT s_suppkey, lower(array_to_string(regexp_extract_all(name, '[A-Za-z]+|[0-9]+'), ' ')) AS words FROM s""")
def identifier_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("s_name", F.lit("XMLPackage2ReadUTF"), "s_nationkey")
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(T.identifier_words(name), " ").alias("words"))


@entry(r"""
    WITH t AS (SELECT o_orderkey, 'CatalogRef.C' || o_custkey || ', String(' || o_custkey % 9 || ', Variable), ' || o_orderpriority AS type_desc FROM orders)
    SELECT o_orderkey, 'CatalogRef>C' || split_part(split_part(type_desc, ',', 1), 'C', 3) || '>|String>>' || regexp_extract(type_desc, '\((.*)\)', 1) || '|' || split_part(type_desc, '), ', 2) || '>>' AS parts FROM t""")
def type_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("CatalogRef.C"), "o_custkey", F.lit(", String("), F.col("o_custkey") % 9, F.lit(", Variable), "), "o_orderpriority")
    none = lambda c: F.coalesce(c, F.lit(""))
    parts = F.transform(T.type_targets(text), lambda t: F.concat_ws(">", t["head"], none(t["target"]), none(t["arguments"])))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(parts, "|").alias("parts"))
