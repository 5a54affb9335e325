"""Cards of procedures: a header that names a procedure in words, and its body in pieces; their index and its search.

``procedures``: proc_id, source_id, module, procedure, kind, is_export, start_line, end_line, directive, signature, region,
comment. ``modules``: source_id, module, text. ``objects``: source_id, object, synonym.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.terms import word_roots
from quarry.functions.text import chunk_lines, identifier_words
from quarry.operators import search
from quarry.operators.snapshots import object_of

CHUNK_CHARS = 1500
CARD_FORMAT = 1
#: Weights of the fields in the rank, and what exports and callers add to it.
WEIGHTS = {"head": 8.0, "body": 1.0}
EXPORT_BONUS = 0.15
POPULARITY = 0.03
#: Chunks that are ranked before the best of each procedure is taken, and the share beyond which a term is common.
POOL = 200
COMMON_SHARE = 0.5
LEAST_TERMS = 2


def header(procedure: Column, signature: Column, kind: Column, directive: Column, module: Column, object_: Column, synonym: Column, region: Column, comment: Column) -> Column:
    """The lines of a card's header; lines without content are left out."""
    text = lambda c: F.coalesce(c, F.lit(""))
    line = lambda label, c: F.when(text(c) != "", F.concat(F.lit(f"{label}: "), c))
    named = F.when(text(signature) != "", signature).otherwise(F.concat(kind, F.lit(" "), procedure, F.lit("()")))
    inner = F.when(object_.contains("."), F.regexp_replace(object_, r"^[^.]*\.", "")).otherwise(object_)
    words = F.concat(identifier_words(procedure), F.when(text(object_) != "", F.concat(F.array(F.lit("|")), identifier_words(inner))).otherwise(F.array().cast("array<string>")))
    roots = F.array_sort(F.array_distinct(F.flatten(F.transform(words, word_roots))))
    return F.concat_ws(
        "\n", F.concat_ws(" ", F.when(text(directive) != "", directive), named), F.concat(F.lit("words: "), F.array_join(words, " ")), line("roots", F.array_join(roots, " ")), F.concat(F.lit("module: "), module),
        line("object", F.concat_ws(" - ", F.when(text(object_) != "", object_), F.when(text(synonym) != "", synonym))), line("region", region), line("about", comment),
    )


def cards(procedures: DataFrame, modules: DataFrame, objects: DataFrame, limit: int = CHUNK_CHARS) -> DataFrame:
    """proc_id, chunk_no, start_line, end_line, head, body, content_hash: the card of each procedure in chunks of its body.

    The synonym is that of the procedure's object in its own source, else in any. A module's text is joined once; a
    procedure without text has one chunk without a body.
    """
    own = objects.select("source_id", F.lower("object").alias("key"), F.col("synonym").alias("own"))
    anywhere = objects.filter("synonym != ''").groupBy(F.lower("object").alias("key")).agg(F.min_by("synonym", "source_id").alias("any"))
    rows = procedures.withColumn("object", F.when(F.col("module").contains("."), object_of(F.col("module"))).otherwise("")).withColumn("key", F.lower("object"))
    rows = rows.join(own, ["source_id", "key"], "left").join(anywhere, "key", "left").withColumn("synonym", F.coalesce(F.when(F.col("own") != "", F.col("own")), "any", F.lit("")))
    rows = rows.join(modules.select("source_id", "module", "text"), ["source_id", "module"], "left")
    body = F.slice(F.split("text", "\r?\n", -1), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1)
    head = header(*[F.col(c) for c in ("procedure", "signature", "kind", "directive", "module", "object", "synonym", "region", "comment")])
    rows = rows.select("proc_id", "start_line", "end_line", head.alias("head"), F.transform(body, lambda x: F.rtrim(x)).alias("lines"))
    pieces = F.when(F.coalesce(F.size("lines"), F.lit(0)) > 0, chunk_lines(F.col("lines"), limit))
    rows = rows.withColumn("pieces", pieces)
    digest = F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit(f"card:{CARD_FORMAT}\n"), F.col("head"), F.lit("\n"), F.array_join(F.transform(F.coalesce("pieces", F.array().cast(rows.schema["pieces"].dataType)), lambda p: F.concat(p["text"], F.lit("\0"))), "")), 256))
    rows = rows.withColumn("content_hash", digest).select("proc_id", "start_line", "end_line", "head", "content_hash", F.posexplode_outer("pieces").alias("chunk_no", "p"))
    shift = lambda c, whole: F.coalesce(F.col("start_line") + F.col(c) - 1, F.col(whole))
    return rows.select("proc_id", F.coalesce("chunk_no", F.lit(0)).alias("chunk_no"), shift("p.first", "start_line").alias("start_line"), shift("p.last", "end_line").alias("end_line"), "head", F.coalesce("p.text", F.lit("")).alias("body"), "content_hash")


def stale(stored: DataFrame, now: DataFrame) -> DataFrame:
    """module keys whose cards must be built again: those never built, or built with another synonym or format.

    ``stored`` and ``now``: source_id, module, synonym, card_format.
    """
    return now.join(stored, ["source_id", "module", "synonym", "card_format"], "left_anti").select("source_id", "module")


def refresh(stored: DataFrame, rebuilt: DataFrame, procedures: DataFrame) -> DataFrame:
    """The card table after ``rebuilt`` cards replace those of their procedures; cards of vanished procedures go."""
    return stored.join(rebuilt.select("proc_id").distinct(), "proc_id", "left_anti").join(procedures.select("proc_id"), "proc_id", "left_semi").unionByName(rebuilt)


def index(found: DataFrame) -> DataFrame:
    """The postings of cards by chunk (key: proc_id and chunk_no in one struct ``chunk``)."""
    return search.postings(found.withColumn("chunk", F.struct("proc_id", "chunk_no")), "chunk", {"head": "head", "body": "body"})


def rare_terms(vocab: DataFrame, total: int, terms: list[str]) -> list[str]:
    """``terms`` without those in over half of all chunks, but at least the two rarest; the vocabulary tells, as an upper bound."""
    if len(terms) <= LEAST_TERMS:
        return terms
    df = {r.term: min(1.0, r.n / max(1, total)) for r in search.expand_prefixes(vocab, terms).join(vocab, "token").groupBy("term").agg(F.sum("df").alias("n")).collect()}  # a row for each term
    share = lambda t: df.get(t, 0.0)
    rare = {t for t in terms if share(t) <= COMMON_SHARE}
    if len(rare) < LEAST_TERMS:
        rare = set(sorted(terms, key=share)[:LEAST_TERMS])
    return [t for t in terms if t in rare]


def callers_of(resolved: DataFrame) -> DataFrame:
    return resolved.filter("target is not null").groupBy(F.col("target").alias("proc_id")).agg(F.count(F.lit(1)).alias("callers"))


def search_cards(post: DataFrame, chunks: DataFrame, procedures: DataFrame, callers: DataFrame, query: str, terms: list[str], glossary: list | None = None, limit: int = 20, pool: int = POOL) -> DataFrame:
    """rank, proc_id, chunk_no, score, match (glossary, exact_name, fts): the procedures a query finds, the best first.

    Procedures that the glossary names come first, in its order; then, for a query that is one identifier of four
    letters or more, those of exactly that name: the most called, exported ones, those of common modules, by name. Then
    the ``pool`` best chunks by weighted BM25, more by export and callers; of each procedure its best chunk.
    """
    spark = post.sparkSession
    called = procedures.join(callers, "proc_id", "left").withColumn("callers", F.coalesce("callers", F.lit(0)))
    tiers = []
    if glossary:
        wanted = spark.createDataFrame([(p, float(i)) for i, p in enumerate(glossary)], "proc_id long, pos double")
        tiers.append(wanted.join(procedures.select("proc_id"), "proc_id", "left_semi").select(F.lit(0).alias("tier"), "pos", "proc_id", F.lit(0).alias("chunk_no"), F.lit(0.0).alias("score"), F.lit("glossary").alias("match")))
    name = query.strip().lower()
    if len(name) >= 4 and name.replace("_", "a").isalnum():
        order = Window.orderBy(F.desc("callers"), F.desc("is_export"), F.desc(F.lower("module").startswith("общиймодуль.")), "module", "proc_id")
        exact = called.filter(F.lower("procedure") == name).orderBy(F.desc("callers"), F.desc("is_export"), F.desc(F.lower("module").startswith("общиймодуль.")), "module", "proc_id").limit(limit)
        tiers.append(exact.select(F.lit(1).alias("tier"), F.row_number().over(order).cast("double").alias("pos"), "proc_id", F.lit(0).alias("chunk_no"), F.lit(0.0).alias("score"), F.lit("exact_name").alias("match")))
    scored = search.bm25_terms(post, search.lengths(post, "chunk"), "chunk", terms, WEIGHTS).select(F.col("chunk.proc_id").alias("proc_id"), F.col("chunk.chunk_no").alias("chunk_no"), "score")
    ranked = scored.join(called.select("proc_id", "is_export", "callers"), "proc_id")
    ranked = ranked.withColumn("score", -F.col("score") * (1 + EXPORT_BONUS * F.col("is_export").cast("int"))).orderBy("score", "proc_id", "chunk_no").limit(pool)
    ranked = ranked.withColumn("score", F.col("score") * (1 + POPULARITY * F.log1p("callers")))
    tiers.append(ranked.select(F.lit(2).alias("tier"), F.col("score").alias("pos"), "proc_id", "chunk_no", "score", F.lit("fts").alias("match")))
    found = tiers[0]
    for t in tiers[1:]:
        found = found.unionByName(t)
    best = found.groupBy("proc_id").agg(F.min(F.struct("tier", "pos", "chunk_no", "score", "match")).alias("m")).select("proc_id", "m.*")
    # At most pool and limit rows.
    rank = F.row_number().over(Window.orderBy("tier", "pos", "proc_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= limit).select("rank", "proc_id", "chunk_no", "score", "match").orderBy("rank")


def snippet(text: Column, terms: list[str], width: int = 240) -> Column:
    """The first line that holds a term, else the first line, cut at ``width`` characters."""
    lines = F.split(text, "\n", -1)
    hit = F.filter(lines, lambda x: F.array_contains(F.array(*[F.lower(x).contains(t) for t in terms]), True)) if terms else F.array().cast("array<string>")
    return F.substring(F.trim(F.coalesce(F.get(hit, F.lit(0)), F.get(lines, F.lit(0)))), 1, width)
