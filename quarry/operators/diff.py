"""Status of rows between two snapshots, last versions, upserts, unified diffs of texts."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def status(old: DataFrame, new: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """keys, status: added, removed or changed rows between two snapshots; equal rows are left out."""
    a = old.select(*keys, F.struct(*compared).alias("was"))
    b = new.select(*keys, F.struct(*compared).alias("now"))
    state = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return a.join(b, keys, "full_outer").withColumn("status", state).filter("status is not null").select(*keys, "status")


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last version of each key, by partial aggregation and not by sorting each key's history."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("m")).select(*keys, "m.*")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The snapshot after ``changes`` (rows that replace or join the table's)."""
    return table.join(changes, keys, "left_anti").unionByName(changes)


@F.pandas_udf(StringType())
def unified_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    """The unified diff of two texts with three lines of context; empty where they are equal; null counts as empty."""

    def lines(a: str | None, b: str | None) -> str:
        return "\n".join(difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), "old", "new", n=3, lineterm=""))

    return pd.Series([lines(a, b) for a, b in zip(old, new, strict=True)])


def text_status(old: Column, new: Column) -> Column:
    """same, changed, added, removed, missing where neither side has a text, or unreadable where one holds a replacement mark."""
    bad = lambda c: F.coalesce(c.contains("\ufffd"), F.lit(False))
    return F.when(bad(old) | bad(new), "unreadable").when(old.isNull() & new.isNull(), "missing").when(old.isNull(), "added").when(new.isNull(), "removed").when(old == new, "same").otherwise("changed")
