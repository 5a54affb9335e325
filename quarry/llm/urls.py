"""URL filter: rules of hosts and paths, and gradient-boosted trees for the URLs that no rule fits.

The trees learn from the URLs that rules label, on lexical features alone, and are compiled into Spark columns.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import trees

#: (verdict, rule); a rule is a host and a path that starts with a slash.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: At most so many labelled URLs train the trees: those with the smallest hash.
MAX_TRAIN_ROWS = 20_000
SUFFIXES = ("com", "net", "org", "edu", "gov", "io", "info", "biz")
FEATURES = ("length", "host_length", "path_length", "host_depth", "path_depth", "digit_ratio", "entropy", "parameters", "fragment", "hyphens", "https", "suffix_length", *(f"suffix_{x}" for x in SUFFIXES))


def url_host(url: Column) -> Column:
    """What stands between the first ``://`` and the next slash, question mark or hash, A-Z in lower case; else empty."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def fits(host: Column, path: Column, rule: str) -> Column:
    rule_host, slash, rest = rule.partition("/")
    return ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(slash + rest)


def matched_rule(host: Column, path: Column) -> Column:
    """The longest rule that fits, or null."""
    longest = sorted((rule for _, rule in RULES), key=lambda r: (-len(r), r))
    return F.coalesce(*[F.when(fits(host, path, r), F.lit(r)) for r in longest], F.lit(None).cast("string"))


def entropy(text: Column) -> Column:
    """Bits per character of the text's own distribution of characters."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.greatest(F.size(chars), F.lit(1)).cast("double")
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))).cast("double") / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))


def features(url: Column, host: Column, path: Column) -> list[Column]:
    """The lexical features of a URL, in the order of FEATURES; a null URL counts as empty."""
    url = F.coalesce(url, F.lit(""))
    suffix = F.regexp_extract(host, r"([^.]*)$", 1)
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    size = lambda c: F.length(c).cast("double")
    return [
        size(url), size(host), size(path), count(host, r"\."), count(path, "/"), count(url, "[0-9]") / F.greatest(size(url), F.lit(1.0)), entropy(url),
        count(url, "[?&][^=&#]*="), F.when(url.contains("#"), 1.0).otherwise(0.0), count(url, "[-_]"), F.when(url.startswith("https"), 1.0).otherwise(0.0), size(suffix),
        *(F.when(suffix == x, 1.0).otherwise(0.0) for x in SUFFIXES),
    ]


def train(rows: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> tuple[float, list[trees.Node]]:
    """Trees from ``rows`` (url, features, blocked): the distinct labelled URLs with the smallest hashes."""
    sample = rows.select("url", "features", "blocked").dropDuplicates(["url"]).orderBy(F.xxhash64("url"), "url").limit(max_rows).collect()
    x = np.array([r["features"] for r in sample], np.float64).reshape(-1, len(FEATURES))
    return trees.boost(x, np.array([float(r["blocked"]) for r in sample]), trees=24, depth=3)


def filter_urls(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the trees' probability of block) of every page.

    A null URL, or one without ``://``, has an empty host and path, fits no rule and is judged by the trees. Repeated
    rows are each judged. With no labelled URL the score is 0.5 and the verdict allow; no pages give no rows.
    """
    url = F.col("url").cast("string")
    rows = pages.select("page_id", url.alias("url")).withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url"))).withColumn("rule", matched_rule(F.col("host"), F.col("path")))
    rows = rows.withColumn("features", F.array(*features(F.col("url"), F.col("host"), F.col("path"))))
    blocked = reduce(lambda c, r: c.when(F.col("rule") == r[1], F.lit(r[0] == "block")), RULES[1:], F.when(F.col("rule") == RULES[0][1], F.lit(RULES[0][0] == "block")))
    rows = rows.withColumn("blocked", blocked)
    start, found = train(rows.filter("rule is not null"))
    columns = [F.col("features")[i] for i in range(len(FEATURES))]
    margin = reduce(lambda total, tree: total + F.lit(0.3) * trees.tree_column(tree, columns), found, F.lit(start))
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))
    verdict = F.when(F.coalesce("blocked", score > 0.5), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), score.alias("score"))
