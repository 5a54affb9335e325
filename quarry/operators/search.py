"""Lexical search: filters, tiers, postings, BM25, cascades and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import TOKEN, tokens

K1, B = 1.2, 0.75


def contains_all(column: Column, words: list[str]) -> Column:
    """Every word is a substring, whatever its case."""
    return reduce(lambda a, b: a & b, [F.lower(column).contains(w.lower()) for w in words])


def exact_first(df: DataFrame, column: str, query: str, *tie: str) -> DataFrame:
    """Substring matches; the exact name comes first, then shorter names, then ``tie``."""
    q = query.lower()
    found = df.filter(F.lower(column).contains(q)).withColumn("exact", F.lower(column) == q)
    return found.orderBy(F.desc("exact"), F.length(column), column, *tie)


def canonical_kind(kind: str, aliases: dict[str, str]) -> str:
    """The kind's own name from any spelling of it or of an alias; an unknown one stays, and so finds nothing."""
    known = {k.lower(): v for k, v in aliases.items()} | {v.lower(): v for v in aliases.values()}
    return known.get(kind.strip().lower(), kind)


def of_kind(df: DataFrame, column: str, kind: str, aliases: dict[str, str]) -> DataFrame:
    """The rows of a kind, in whatever case and language it is named; the filter is a plain equality that reaches the scan."""
    return df.filter(F.col(column) == canonical_kind(kind, aliases))


def filtered(df: DataFrame, source_id: str | None = None, path: str | None = None, exported: bool = False) -> DataFrame:
    """Rows of one source, with a fragment in file_path in any case, of exports only; each filter only where it is asked for."""
    out = df.filter(F.col("source_id") == source_id) if source_id else df
    out = out.filter(F.lower("file_path").contains(path.lower())) if path else out
    return out.filter("is_export") if exported else out


def with_more(df: DataFrame, limit: int, offset: int = 0, cap: int = 500) -> tuple[list, bool, bool]:
    """The rows of a page, whether there are more, and whether the limit was cut: one row more than the page is read."""
    asked, limit = limit, min(limit, cap)
    rows = df.offset(offset).limit(limit + 1).collect()  # a page and one row
    return rows[:limit], len(rows) > limit, asked > cap


def page(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One page of an ordered result."""
    return df.offset(offset).limit(limit)


def best_tier(df: DataFrame, tiers: list[Column]) -> DataFrame:
    """The rows of the first condition that any row meets, with its number in ``tier``.

    The tier is a minimum, so one small aggregate is joined back instead of sorting the table in one task.
    """
    ranked = df.withColumn("tier", F.coalesce(*[F.when(c, F.lit(i)) for i, c in enumerate(tiers)], F.lit(None).cast("int"))).filter("tier is not null")
    return ranked.join(F.broadcast(ranked.agg(F.min("tier").alias("tier"))), "tier")  # one row


def prefix_fallback(df: DataFrame, column: str, word: str, shortest: int = 2) -> DataFrame:
    """Matches of the longest prefix of ``word`` that matches anything, in one pass."""
    prefixes = [word[:n].lower() for n in range(len(word), shortest - 1, -1)]
    return best_tier(df, [F.lower(column).contains(p) for p in prefixes]).withColumn("prefix", F.element_at(F.array(*map(F.lit, prefixes)), F.col("tier") + 1))


def postings(docs: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """key, field, token, tf; ``fields`` maps a field's name to its column. Tokens are counted within their row, so nothing shuffles."""
    counted = lambda c: F.explode(F.transform(F.array(F.array_sort(tokens(F.col(c)))), _runs)[0])
    parts = [docs.select(key, F.lit(f).alias("field"), counted(c).alias("t")).select(key, "field", "t.token", "t.tf") for f, c in fields.items()]
    return reduce(DataFrame.unionByName, parts)


def _runs(ordered: Column) -> Column:
    """The runs of equal tokens in a sorted array: array of (token, tf)."""
    starts = F.filter(F.sequence(F.lit(0), F.size(ordered)), lambda i: (i < F.size(ordered)) & ((i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1))))

    def runs(at: Column) -> Column:
        return F.transform(at, lambda i, k: F.struct(F.get(ordered, i).alias("token"), (F.coalesce(F.get(at, k + 1), F.size(ordered)) - i).cast("long").alias("tf")))

    return F.transform(F.array(starts), runs)[0]


def write_index(post: DataFrame, path: str, parts: int = 16) -> None:
    """Write postings in ranges of tokens, sorted, so that the files' statistics prune a read of a prefix."""
    post.repartitionByRange(parts, "token").sortWithinPartitions("token").write.mode("overwrite").parquet(path)


def in_prefixes(post: DataFrame, terms: list[str]) -> DataFrame:
    """The postings (or words) that start with one of the terms, as ranges of tokens that reach the scan."""
    ranges = [(F.col("token") >= t) & (F.col("token") < t[:-1] + chr(ord(t[-1]) + 1)) for t in terms]
    return post.filter(reduce(lambda a, b: a | b, ranges))


def vocabulary(post: DataFrame, key: str) -> DataFrame:
    """token, df: in how many documents it is, whatever the field."""
    return post.groupBy("token", key).agg(F.lit(1).alias("x")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def document_frequencies(docs: DataFrame, text: str) -> DataFrame:
    """token, df of one column, without an index: each document's distinct tokens count one."""
    return docs.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def lengths(post: DataFrame, key: str) -> DataFrame:
    return post.groupBy(key).agg(F.sum("tf").alias("len"))


def expand_prefixes(vocab: DataFrame, terms: list[str]) -> DataFrame:
    """token, term: the words of a vocabulary that start with each term."""
    return in_prefixes(vocab, terms).select("token", F.explode(_started(F.col("token"), terms)).alias("term"))


def _started(token: Column, terms: list[str]) -> Column:
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.startswith(token, t))


def hits(post: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """key, term, field, hits of prefix terms; the terms' ranges reach the postings as filters."""
    return in_prefixes(post, terms).withColumn("term", F.explode(_started(F.col("token"), terms))).groupBy(key, "term", "field").agg(F.sum("tf").alias("hits"))


def bm25_terms(post: DataFrame, sizes: DataFrame, key: str, terms: list[str], weights: dict[str, float]) -> DataFrame:
    """key, score of the documents of an index that have one of the prefix terms."""
    return bm25(hits(post, key, terms), sizes, key, weights)


def scanned(docs: DataFrame, key: str, fields: dict[str, str], terms: list[str], weights: dict[str, float]) -> DataFrame:
    """key, len, f (array of the weighted hits of each prefix term) of every document: an index-free read, without a shuffle.

    Tokens and hits are counted in the text, at the places where tokens start; no array of tokens is made.
    """
    low = docs.select(key, *[F.lower(F.coalesce(F.col(c), F.lit(""))).alias(f) for f, c in fields.items()])
    start = TOKEN[1:-2]  # one character of a token
    count = lambda f, t: F.regexp_count(F.col(f), F.lit(rf"\Q{t}\E(?<!{start}\Q{t}\E)")) * F.lit(float(weights[f]))
    add = lambda parts: reduce(lambda a, b: a + b, parts)
    found = F.array(*[add([count(f, t) for f in fields]) for t in terms])
    return low.select(key, add([F.regexp_count(F.col(f), F.lit(TOKEN)) for f in fields]).cast("long").alias("len"), found.alias("f"))


def scan_bm25(docs: DataFrame, key: str, fields: dict[str, str], terms: list[str], weights: dict[str, float]) -> DataFrame:
    """key, score of every document with one of the prefix terms: two reads, and between them one row of counts."""
    rows = scanned(docs, key, fields, terms, weights)
    n = len(terms)
    stats = rows.filter("len > 0").agg(F.count(F.lit(1)).alias("total"), F.avg("len").alias("mean"), F.array(*[F.count(F.when(F.get("f", F.lit(i)) > 0, 1)) for i in range(n)]).alias("n"))
    rows = rows.filter(F.exists("f", lambda f: f > 0)).crossJoin(F.broadcast(stats))  # one row
    idf = lambda df: F.greatest(F.log((F.col("total") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
    part = lambda f, df: F.when(f > 0, idf(df) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("mean")))).otherwise(0.0)
    return rows.select(key, reduce(lambda a, b: a + b, [part(F.get("f", F.lit(i)), F.get("n", F.lit(i))) for i in range(n)]).alias("score"))


def scan_all(docs: DataFrame, key: str, fields: dict[str, str], terms: list[str]) -> DataFrame:
    """key, hits of the documents with every prefix term, the most hits first."""
    rows = scanned(docs, key, fields, terms, dict.fromkeys(fields, 1.0)).filter(F.forall("f", lambda f: f > 0))
    return rows.select(key, F.aggregate("f", F.lit(0.0), lambda a, b: a + b).cast("long").alias("hits")).orderBy(F.desc("hits"), key)


def match_all(found: DataFrame, key: str, n_terms: int) -> DataFrame:
    """key and hits of the documents with every term, the most hits first."""
    by_term = found.groupBy(key, "term").agg(F.sum("hits").alias("hits"))
    both = by_term.groupBy(key).agg(F.count(F.lit(1)).alias("terms"), F.sum("hits").alias("hits"))
    return both.filter(F.col("terms") == n_terms).drop("terms").orderBy(F.desc("hits"), key)


def bm25(found: DataFrame, lengths: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """key, score: weighted Okapi BM25; ``lengths`` has key and len of every document."""
    weight = reduce(lambda c, kv: c.when(F.col("field") == kv[0], F.lit(kv[1])), weights.items(), F.when(F.lit(False), F.lit(0.0)))
    by_term = found.groupBy(key, "term").agg(F.sum(F.col("hits") * weight).alias("f"))
    rarity = by_term.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    corpus = lengths.agg(F.count(F.lit(1)).alias("total"), F.avg("len").alias("mean"))
    idf = F.greatest(F.log((F.col("total") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(1e-6))
    rows = by_term.join(F.broadcast(rarity), "term").join(lengths, key).crossJoin(F.broadcast(corpus))  # a row for each term; one row
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return rows.groupBy(key).agg(F.sum(part).alias("score"))


def cascade(tiers: list[DataFrame], key: str) -> DataFrame:
    """Union of ordered candidate lists (key, pos), each key in its first tier: key, tier, pos."""
    tagged = reduce(DataFrame.unionByName, [t.select(key, F.lit(i).alias("tier"), F.col("pos").cast("double").alias("pos")) for i, t in enumerate(tiers)])
    return tagged.groupBy(key).agg(F.min(F.struct("tier", "pos")).alias("m")).select(key, "m.tier", "m.pos")


def matching_lines(docs: DataFrame, key: str, text: str, query: str, per_doc: int) -> DataFrame:
    """key, line, context, capped: at most ``per_doc`` lines with the query, each with the lines around it.

    Lines are numbered within their document; the neighbours come from the array, so nothing shuffles but the cap.
    """
    lines = docs.filter(F.lower(text).contains(query.lower())).select(key, F.split(text, "\n", -1).alias("lines"))
    at = F.filter(F.transform("lines", lambda x, i: F.when(F.lower(x).contains(query.lower()), i + 1)), lambda i: i.isNotNull())
    rows = lines.select(key, "lines", at.alias("at")).select(key, "lines", (F.size("at") > per_doc).alias("capped"), F.explode(F.slice("at", 1, per_doc)).alias("line"))
    first = F.greatest(F.col("line") - 1, F.lit(1))
    return rows.select(key, "line", F.array_join(F.slice("lines", first, F.least(F.col("line") + 1, F.size("lines")) - first + 1), "\n").alias("context"), "capped")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rn") <= n)
