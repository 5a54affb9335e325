"""Every catalogue query against its SQL."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent / "support"))
import oracle  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from quarry.plans import registry  # noqa: E402


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows_as_sql(name, spark, con, sf_dir):
    assert oracle.same(entry.queries()[name](spark, sf_dir), con, entry.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(name, spark, sf_dir):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_titles_with_open_and_other_entities(spark, tmp_path):
    """A title may end within an entity, and hold entities that its SQL leaves as they are."""
    titles = ["und&amp;&amp", "a &lt b &LT; c", "&copy; &#39; &#x27; &nbsp;", "&amp;lt; &amp;amp; &lt;&gt;&quot;", "two\nlines &amp;", ""]
    rows = [(i, f"u{i}", f"<html><title>{t}</title></html>") for i, t in enumerate(titles)] + [(90, "u", "<p>none</p>"), (91, "u", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").toPandas().to_parquet(tmp_path / "pages.parquet")
    assert oracle.same(entry.queries()["page_titles"](spark, str(tmp_path)), oracle.connect(str(tmp_path)), entry.oracle_sql()["page_titles"]) == ""


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
