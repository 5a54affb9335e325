"""Aggregations over calls and over search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    return F.round(100.0 * part / whole, 1)


def resolution(calls: DataFrame, by: str, resolved: str) -> DataFrame:
    """by, total, resolved, pct: how many calls have a target."""
    out = calls.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.count(resolved).alias("resolved"))
    return out.withColumn("pct", ratio(F.col("resolved"), F.col("total")))


def worst(rates: DataFrame, key: str, least: int, n: int) -> DataFrame:
    """The ``n`` lowest rates among those with ``least`` calls."""
    return rates.filter(F.col("total") >= least).orderBy("pct", F.desc("total"), key).limit(n)


def retrieval(ranks: DataFrame, rank: str, *by: str) -> DataFrame:
    """n, hit1, hit5, hit10, mrr over cases whose rank is null where nothing was found."""
    hit = lambda k: F.round(F.avg(F.when(F.col(rank) <= k, 1.0).otherwise(0.0)), 6).alias(f"hit{k}")
    return ranks.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), hit(1), hit(5), hit(10), F.round(F.avg(F.coalesce(1.0 / F.col(rank), F.lit(0.0))), 6).alias("mrr"))


def overall(calls: DataFrame, key: str, kind: str, resolved: str, same: dict[str, str]) -> DataFrame:
    """kind, total, resolved, pct by kind and for all together (kind null); ``same`` maps kinds to the one they count as.

    Distinct calls are counted, so a call with several targets is one.
    """
    named = F.col(kind)
    for alias, real in same.items():
        named = F.when(named == alias, real).otherwise(named)
    rows = calls.groupBy(key, named.alias("kind")).agg(F.max(F.col(resolved).isNotNull()).alias("hit"))
    figures = [F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("hit"), 1)).alias("resolved")]
    both = rows.groupBy("kind").agg(*figures).unionByName(rows.agg(F.lit(None).cast("string").alias("kind"), *figures))
    return both.withColumn("pct", F.when(F.col("total") > 0, ratio(F.col("resolved"), F.col("total"))).otherwise(0.0))


def evaluation(results: DataFrame, by: str = "method") -> DataFrame:
    """``by``, kind (null for all), n, hit1, hit5, hit10, mrr, negatives, negatives_with_results, ms_p50, ms_p95.

    ``results``: by, kind, expected (whether a case has an answer), rank (null if not found), returned, ms. Hits are of
    cases with an answer; a negative case counts if it returned anything. p95 is the value at place int(0.95 n) - 1,
    from 0, of the times in order; both percentiles are exact.
    """
    rank, answer = F.col("rank"), F.col("expected")
    n = F.count(F.when(answer, 1))
    share = lambda c: F.coalesce(F.sum(F.when(answer & c, 1.0)), F.lit(0.0)) / F.greatest(n, F.lit(1))
    figures = [
        n.alias("n"), share(rank == 1).alias("hit1"), share(rank <= 5).alias("hit5"), share(rank <= 10).alias("hit10"),
        (F.coalesce(F.sum(F.when(answer, 1.0 / rank)), F.lit(0.0)) / F.greatest(n, F.lit(1))).alias("mrr"),
        F.count(F.when(~answer, 1)).alias("negatives"), F.count(F.when(~answer & (F.col("returned") > 0), 1)).alias("negatives_with_results"),
    ]
    order = Window.partitionBy(by).orderBy("ms")
    times = results.select(by, "ms", F.row_number().over(order).alias("at"), F.count(F.lit(1)).over(Window.partitionBy(by)).alias("all"))
    times = times.groupBy(by).agg(F.median("ms").alias("ms_p50"), F.max(F.when(F.col("at") == F.greatest(F.floor(F.col("all") * 0.95), F.lit(1)), F.col("ms"))).alias("ms_p95"))
    whole = results.groupBy(by).agg(F.lit(None).cast("string").alias("kind"), *figures).join(times, by)
    kinds = results.filter(answer).groupBy(by, "kind").agg(*figures).withColumns({"ms_p50": F.lit(None).cast("double"), "ms_p95": F.lit(None).cast("double")})
    return whole.unionByName(kinds.select(*whole.columns))
