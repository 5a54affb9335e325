"""Personal data: base patterns, and more identifiers by bootstrapped contextual extraction. DataFrame functions only.

The base patterns find seed entities; long hexadecimal tokens are seeds of a fifth kind, secret. The words around each
identifier-like token are its lexical patterns: the word before, the two before, the word after, and those on both
sides. Patterns and instances form a graph whose scores are computed in a few rounds, from the seeds' instances to
their patterns and back. Instances that the base patterns miss but that stand in patterns of high confidence become
spans too, secrets among them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, running_starts, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: The kinds of spans: those of the base patterns, and secrets, which contexts alone add.
SPAN_KINDS = (*KINDS, "secret")
#: The contract's patterns. Possessive repeats and the start at a run's first character (or where the last match
#: ended) leave the matches as they are and make the search linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: An identifier-like stretch: a token with a digit or an at sign, and the groups of digits that go on after a digit and a space.
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+(?:(?<=[0-9)])\x20\(?[0-9][0-9().-]*+)*+"
#: Characters that mark matches; the private-use character they take the place of in a text matches no pattern.
MARK, OTHER = "", ""

#: Rounds of scoring; least confidence of a pattern or instance; distinct seeds that a pattern needs.
ROUNDS = 3
CONFIDENCE = 0.7
SUPPORT = 3
#: Shortest identifier that a pattern may discover.
LEAST_LENGTH = 5
#: A seed of the kind secret: a hexadecimal token with both letters and digits.
SECRET = r"^(?=.*[0-9])(?=.*[a-fA-F])[0-9a-fA-F]{32,}$"

Span = "struct<kind:int,start:bigint,stop:bigint>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    each = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(each, value), F.lit(0), lambda a, b: a + b) % 10 == 0


def holds(kind: str, match: Column) -> Column:
    """Whether a match of a base pattern is an entity of its kind."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def split_marked(text: Column, pattern: str) -> Column:
    """Gaps and matches in turn, starting with a gap."""
    return F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)


def kind_spans(text: Column, kind: str) -> Column:
    """Spans of one kind, in code points."""
    none = F.array().cast(f"array<{Span}>")

    def spans(parts: Column) -> Column:
        one = lambda p, at: F.struct(F.lit(KINDS.index(kind)).alias("kind"), at.alias("start"), (at + F.length(p)).alias("stop"))
        found = lambda starts: F.filter(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.when(holds(kind, p), one(p, F.get(starts, i))))), lambda x: x.isNotNull())
        return F.when(F.size(parts) > 1, let(running_starts(F.transform(parts, F.length)), found)).otherwise(none)

    likely = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]"), "phone": text.contains("+")}[kind]
    return F.when(likely, let(split_marked(text, PATTERNS[kind]), spans)).otherwise(none)


def seed_kind(value: Column) -> Column:
    """The number of the kind of seed that a stretch holds, or null."""
    out = F.when(value.rlike(SECRET), F.lit(len(KINDS)))
    for i, kind in reversed(list(enumerate(KINDS))):
        match = F.regexp_extract(value, PATTERNS[kind], 0)
        out = F.when((match != "") & holds(kind, match), F.lit(i)).otherwise(out)
    return out


def candidates(text: Column) -> Column:
    """Identifier-like stretches: array of (start, stop, value, patterns); punctuation around a stretch is left off."""
    item = "struct<start:bigint,stop:bigint,value:string,patterns:array<string>>"
    none = F.array().cast(f"array<{item}>")
    words = lambda gap: F.filter(F.split(F.lower(gap), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def stretch(part: Column, at: Column, before: Column, after: Column) -> Column:
        value = F.regexp_extract(part, r"(?s)^[\"'(\[{<,;:]*+(.*?)[\"')\]}>.,;:!?$%&*#|]*$", 1)
        first = at + F.length(F.regexp_extract(part, r"^[\"'(\[{<,;:]*+", 0))
        last, next_ = F.try_element_at(before, F.lit(-1)), F.try_element_at(after, F.lit(1))
        far = F.when(F.size(before) > 1, F.concat_ws(" ", F.try_element_at(before, F.lit(-2)), last))
        patterns = F.array(F.concat(F.lit("1 "), last), F.concat(F.lit("2 "), far), F.concat(F.lit("3 "), next_), F.concat(F.lit("4 "), last, F.lit(" _ "), next_))
        return F.struct(first.alias("start"), (first + F.length(value)).alias("stop"), value.alias("value"), F.filter(patterns, lambda p: p.isNotNull()).alias("patterns"))

    def stretches(parts: Column) -> Column:
        gaps = F.transform(parts, lambda p, i: F.when(i % 2 == 0, words(p)))
        one = lambda p, i, starts, around: F.when(i % 2 == 1, stretch(p, F.get(starts, i), F.get(around, i - 1), F.get(around, i + 1)))
        found = lambda s: F.filter(F.transform(parts, lambda p, i: one(p, i, s["starts"], s["around"])), lambda x: x.isNotNull())
        return F.when(F.size(parts) > 1, let(F.struct(running_starts(F.transform(parts, F.length)).alias("starts"), gaps.alias("around")), found)).otherwise(none)

    return F.when(text.rlike("[0-9@]"), let(split_marked(text, CANDIDATE), stretches)).otherwise(none)


def discover(found: DataFrame) -> DataFrame:
    """row, kind, start, stop of stretches that stand in confident patterns and are no base entities.

    ``found``: row, start, stop, value, patterns. A pattern's confidence for a kind is the score of its distinct
    instances, summed, over their number and one more; patterns need SUPPORT distinct seeds. An instance's score is
    its best pattern's. Both are aggregated before they shuffle, and hot patterns are joined from written tables.
    """
    uses = found.select("row", "start", "stop", "value", seed_kind(F.col("value")).alias("seed"), F.explode(F.array_distinct("patterns")).alias("pattern"))
    uses = materialize(uses, "uses")
    edges = materialize(uses.groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "edges")
    supported = edges.filter("seed is not null").groupBy("pattern", F.col("seed").alias("kind")).agg(F.count(F.lit(1)).alias("seeds")).filter(F.col("seeds") >= SUPPORT)
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    kinds = materialize(supported.join(sizes, "pattern"), "kinds")
    # Every pair of an instance and a kind that one of its supported patterns may have.
    graph = materialize(edges.join(kinds.select("pattern", "kind", "n"), "pattern").withColumn("score", F.when(F.col("seed") == F.col("kind"), 1.0).otherwise(0.0)), "graph")
    confident = None
    for _ in range(ROUNDS):
        confident = graph.groupBy("pattern", "kind").agg((F.sum("score") / (F.max("n") + 1)).alias("confidence"))
        confident = materialize(confident, "confidence")
        scored = graph.join(confident, ["pattern", "kind"]).groupBy("value", "kind").agg(F.max("confidence").alias("best"))
        scored = materialize(scored, "scored")
        graph = materialize(graph.select("pattern", "value", "seed", "kind", "n").join(scored, ["value", "kind"]).select("pattern", "value", "seed", "kind", "n", F.when(F.col("seed") == F.col("kind"), 1.0).otherwise(F.when(F.col("seed").isNotNull(), 0.0).otherwise(F.col("best"))).alias("score")), "graph")
    good = materialize(confident.filter(F.col("confidence") >= CONFIDENCE).select("pattern", "kind"), "good")
    fresh = uses.filter((F.col("seed").isNull() | (F.col("seed") >= len(KINDS))) & (F.length("value") >= LEAST_LENGTH) & F.col("value").rlike("[0-9@]"))
    # A seed is of its own kind only.
    fresh = fresh.join(good, "pattern").filter("seed is null or seed = kind")
    return fresh.groupBy("row", "start", "stop").agg(F.min("kind").alias("kind"))


def written(spans: Column) -> Column:
    kind = F.array(*[F.lit(k) for k in SPAN_KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans of every text.

    Counts and digest are of the base patterns' spans; ``spans`` has those that contexts add as well, where they don't
    overlap a base span; n_added counts those, n_spans all. Spans are kind:start:end in code points, by start, then
    kind; added ones may be of the kind secret. Added identifiers have LEAST_LENGTH characters and any length above. A
    null or empty text has none. Rows are known by number, so repeated and null ids do no harm; few or no seeds add
    nothing; no documents give no rows; other columns are ignored.
    """
    text = F.translate(text_or_empty(), MARK, OTHER)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    order = lambda spans: F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(F.signum(a["kind"] - b["kind"]).cast("int")))
    rows = rows.select("doc_id", *[kind_spans(F.col("text"), k).alias(k) for k in KINDS], candidates(F.col("text")).alias("stretches"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "entities")
    rows = rows.withColumn("base", order(F.concat(*KINDS)))
    found = rows.select("row", F.explode("stretches").alias("s")).select("row", "s.*")
    added = discover(found).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "stop")).alias("added"))
    out = rows.drop("stretches").join(added, "row", "left").withColumn("added", F.coalesce("added", F.array().cast(f"array<{Span}>")))
    apart = F.filter("added", lambda s: ~F.exists("base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
    out = out.withColumn("added", apart)
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(order(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"))
