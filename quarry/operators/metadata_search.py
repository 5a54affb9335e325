"""Search over objects and their attributes: cascades of exact names, glossary, words in names, text matches and ranks.

``objects``: object (full name), kind, name, synonym, comment, source_id. ``attributes``: object, source_id, attribute,
kind, type_desc, synonym, comment. ``form_attributes``: form, source_id, attribute, title, type_desc. ``helps``: object,
source_id, text. Every result has tier and pos, and its rows come in that order with the key as the last tie.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.terms import QUESTION_WORDS, query_stems, query_terms
from quarry.functions.text import query_tokens
from quarry.operators import search

OBJECT_WEIGHTS = {"object": 1.0, "name": 3.0, "synonym": 6.0, "comment": 1.0}
ATTRIBUTE_WEIGHTS = {"attribute": 2.0, "synonym": 4.0, "type_desc": 0.5, "comment": 1.0}
#: Shares of attributes, of help and of the owner in a rank; what a name with all words adds; what data kinds multiply.
ATTRIBUTE_SHARE, HELP_SHARE, OWNER_SHARE = 0.5, 0.15, 0.5
NAMED = -12.0
DATA_BOOST = 1.3
#: Candidates that are taken before ranks are joined.
OBJECT_POOL, ATTRIBUTE_POOL, HELP_POOL = 200, 400, 100
# Kinds of objects that hold data, in the order in which namesakes are shown.
DATA_KINDS = ("РегистрНакопления", "РегистрСведений", "РегистрБухгалтерии", "РегистрРасчета", "Документ", "Справочник", "ПланВидовХарактеристик", "ПланСчетов", "Перечисление")

KEY = ["object", "source_id"]


def kind_order(kind: Column, kinds: tuple[str, ...] = DATA_KINDS) -> Column:
    return reduce(lambda c, x: c.when(kind == x[1], x[0]), enumerate(kinds), F.when(F.lit(False), -1)).otherwise(len(kinds))


def name_stems(query: str) -> list[str]:
    """The shortest stem of each word of a query of two or more words; none for other queries."""
    words = [w for w in dict.fromkeys(query_tokens(query)) if len(w) > 2 and w not in QUESTION_WORDS]
    return [min(query_stems(w) or [w], key=len) for w in words] if len(words) > 1 else []


def _ranked_pool(rows: DataFrame, key: list[str], fields: dict[str, str], terms: list[str], weights: dict[str, float], pool: int) -> DataFrame:
    """key and score (negative, the best lowest) of the ``pool`` best rows."""
    found = search.scan_bm25(rows.withColumn("__key", F.struct(*key)), "__key", fields, terms, weights)
    return found.select("__key.*", (-F.col("score")).alias("score")).orderBy("score", *key).limit(pool)


def ranked_objects(objects: DataFrame, attributes: DataFrame | None, helps: DataFrame | None, query: str, kinds: tuple[str, ...] = DATA_KINDS) -> DataFrame:
    """object, source_id, score: any term of the query, by weighted BM25, the best attribute and the help; the best lowest.

    Objects that are found by an attribute or by help alone have a score of their own of zero. A name that holds all
    words adds NAMED; kinds that hold data are multiplied.
    """
    terms = query_terms(query)
    none = objects.select(*KEY, F.lit(0.0).alias("score")).limit(0)
    if not terms:
        return none
    own = _ranked_pool(objects, KEY, {f: f for f in OBJECT_WEIGHTS}, terms, OBJECT_WEIGHTS, OBJECT_POOL).withColumnRenamed("score", "own")
    best = none.withColumnRenamed("score", "best")
    if attributes is not None:
        pool = _ranked_pool(attributes, [*KEY, "attribute"], {f: f for f in ATTRIBUTE_WEIGHTS}, terms, ATTRIBUTE_WEIGHTS, ATTRIBUTE_POOL)
        best = pool.groupBy(*KEY).agg(F.min("score").alias("best"))
    helped = none.withColumnRenamed("score", "helped")
    if helps is not None:
        helped = _ranked_pool(helps, KEY, {"text": "text"}, terms, {"text": 1.0}, HELP_POOL).withColumnRenamed("score", "helped")
    stems = name_stems(query)
    named = none.drop("score")
    if stems:
        named = objects.filter(search.contains_all(F.col("name"), stems)).select(*KEY).orderBy(*KEY).limit(OBJECT_POOL)
    found = own.join(best, KEY, "full_outer").join(helped, KEY, "full_outer").join(named.withColumn("named", F.lit(NAMED)), KEY, "full_outer")
    found = found.join(objects.select(*KEY, "kind"), KEY)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    score = zero(F.col("own")) + ATTRIBUTE_SHARE * zero(F.col("best")) + HELP_SHARE * zero(F.col("helped")) + zero(F.col("named"))
    return found.select(*KEY, (score * F.when(F.col("kind").isin(*kinds), DATA_BOOST).otherwise(1.0)).alias("score"))


def search_objects(objects: DataFrame, query: str, attributes: DataFrame | None = None, helps: DataFrame | None = None, glossary: list[str] | None = None, limit: int = 20, offset: int = 0, kinds: tuple[str, ...] = DATA_KINDS) -> DataFrame:
    """The objects a query finds: all columns of ``objects``, tier and pos.

    Tier 0: name, full name or synonym equals the query (names before synonyms, then kinds that hold data); 1: objects
    that the glossary names, in its order; 2: names with all words, shorter ones first; 3: all words start tokens of the
    text; 4: ``ranked_objects``; 5, for one word and where nothing else was found: the longest prefix that a name holds.
    An object has the first tier that finds it.
    """
    q = query.strip().lower()
    at = lambda rows, tier, *order: rows.withColumn("tier", F.lit(tier)).withColumn("pos", F.row_number().over(Window.orderBy(*order))).select(*KEY, "tier", "pos")
    pool = limit + offset
    cut = lambda rows, *order: rows.orderBy(*order).limit(pool)
    order = [F.lower("synonym") == q, kind_order(F.col("kind"), kinds), F.col("object"), F.col("source_id")]
    tiers = [at(cut(objects.filter((F.lower("name") == q) | (F.lower("object") == q) | (F.lower("synonym") == q)), *order), 0, *order)]
    if glossary:
        wanted = objects.sparkSession.createDataFrame([(t.lower(), i) for i, t in enumerate(glossary)], "__target string, __at int")
        named = objects.join(F.broadcast(wanted), F.lower("object") == F.col("__target"))
        tiers.append(named.select(*KEY, F.lit(1).alias("tier"), F.col("__at").alias("pos")))
    if stems := name_stems(query):
        order = [F.length("name"), kind_order(F.col("kind"), kinds), F.col("object"), F.col("source_id")]
        named = objects.filter(search.contains_all(F.col("name"), stems)).orderBy("object", "source_id").limit(OBJECT_POOL)
        tiers.append(at(named, 2, *order))
    if words := query_tokens(query):
        whole = objects.withColumn("__key", F.struct(*KEY))
        matched = search.scan_all(whole, "__key", {f: f for f in OBJECT_WEIGHTS}, words).limit(pool).select("__key.*", "hits")
        tiers.append(at(matched, 3, F.desc("hits"), F.col("object"), F.col("source_id")))
        tiers.append(at(ranked_objects(objects, attributes, helps, query, kinds), 4, F.col("score"), F.col("object"), F.col("source_id")))
    found = reduce(DataFrame.unionByName, tiers)
    if len(words) == 1 and len(query.split()) == 1:
        text = F.concat_ws("\n", F.lower("name"), F.lower("object"), F.lower("synonym"))
        shorter = search.prefix_fallback(objects.withColumn("__text", text), "__text", q)
        empty = found.agg(F.count(F.lit(1)).alias("__n")).filter("__n = 0")
        tiers_last = shorter.crossJoin(F.broadcast(empty)).select(*KEY, F.lit(5).alias("tier"), F.lit(0).alias("pos"))  # one row or none
        found = found.unionByName(tiers_last)
    best = found.groupBy(*KEY).agg(F.min(F.struct("tier", "pos")).alias("m")).select(*KEY, "m.tier", "m.pos")
    return search.page(best.join(objects, KEY).orderBy("tier", "pos", *KEY), limit, offset)


def ranked_attributes(objects: DataFrame, attributes: DataFrame, query: str, kinds: tuple[str, ...] = DATA_KINDS) -> DataFrame:
    """object, source_id, attribute, score: an attribute's own rank and a share of its owner's."""
    terms = query_terms(query)
    pool = _ranked_pool(attributes, [*KEY, "attribute"], {f: f for f in ATTRIBUTE_WEIGHTS}, terms, ATTRIBUTE_WEIGHTS, ATTRIBUTE_POOL)
    owners = _ranked_pool(objects, KEY, {f: f for f in OBJECT_WEIGHTS}, terms, OBJECT_WEIGHTS, OBJECT_POOL).withColumnRenamed("score", "owner")
    rows = pool.join(owners, KEY, "left").join(objects.select(*KEY, F.col("kind").alias("object_kind")), KEY)
    boost = F.when(F.col("object_kind").isin(*kinds), DATA_BOOST).otherwise(1.0)
    return rows.select(*KEY, "attribute", ((F.col("score") + OWNER_SHARE * F.coalesce("owner", F.lit(0.0))) * boost).alias("score"))


def search_attributes(objects: DataFrame, attributes: DataFrame, query: str, form_attributes: DataFrame | None = None, glossary: list[tuple[str, str]] | None = None, type_filter: str | None = None, limit: int = 30, offset: int = 0, filter_first: bool = False, kinds: tuple[str, ...] = DATA_KINDS) -> DataFrame:
    """object, source_id, attribute, type_desc, tier, pos of the attributes a query finds.

    Tier 0: those the glossary names, as (object, attribute); 1: all words start tokens, for one word without such
    matches the word in name, synonym or type; 2: attributes of forms that hold all words, the exact name first, then
    names that start with the query; 3: ``ranked_attributes``. ``type_filter`` holds after paging, so that pages may be
    short, unless ``filter_first``.
    """
    key = [*KEY, "attribute"]
    q, words = query.strip().lower(), query_tokens(query)
    need = limit + offset
    at = lambda rows, tier, *order: rows.select(*key, F.lit(tier).alias("tier"), F.row_number().over(Window.orderBy(*order)).alias("pos"))
    ties = [F.col(c) for c in key]
    tiers = []
    if glossary:
        wanted = objects.sparkSession.createDataFrame([(o.lower(), a.lower(), i) for i, (o, a) in enumerate(glossary)], "__o string, __a string, __at int")
        named = attributes.join(F.broadcast(wanted), (F.lower("object") == F.col("__o")) & (F.lower("attribute") == F.col("__a")))
        tiers.append(named.select(*key, F.lit(0).alias("tier"), F.col("__at").alias("pos")))
    if words:
        matched = search.scan_all(attributes.withColumn("__key", F.struct(*key)), "__key", {f: f for f in ATTRIBUTE_WEIGHTS}, words).limit(need).select("__key.*", "hits")
        tiers.append(at(matched, 1, F.desc("hits"), *ties))
        if len(query.split()) == 1:
            empty = matched.agg(F.count(F.lit(1)).alias("__n")).filter("__n = 0")
            inside = attributes.filter(reduce(lambda a, b: a | b, [F.lower(F.coalesce(c, F.lit(""))).contains(q) for c in ("attribute", "synonym", "type_desc")])).orderBy(*key).limit(need)
            tiers.append(at(inside.crossJoin(F.broadcast(empty)), 1, *ties))  # one row or none
    everything = attributes.select(*key, "type_desc")
    if form_attributes is not None and words:
        forms = form_attributes.select(F.col("form").alias("object"), "source_id", "attribute", F.coalesce("type_desc", F.lit("")).alias("type_desc"), F.concat_ws(" ", "attribute", "title", "type_desc").alias("__text"))
        low = F.lower("attribute")
        order = [F.desc(low == q), F.desc(low.startswith(q)), *ties]
        tiers.append(at(forms.filter(search.contains_all(F.col("__text"), query.lower().split())).orderBy(*order).limit(need), 2, *order))
        everything = everything.unionByName(forms.drop("__text"))
    if words:
        tiers.append(at(ranked_attributes(objects, attributes, query, kinds), 3, F.col("score"), *ties))
    if not tiers:
        return everything.limit(0).select("*", F.lit(0).alias("tier"), F.lit(0).alias("pos"))
    best = reduce(DataFrame.unionByName, tiers).groupBy(*key).agg(F.min(F.struct("tier", "pos")).alias("m")).select(*key, "m.tier", "m.pos")
    rows = best.join(everything.groupBy(*key).agg(F.min("type_desc").alias("type_desc")), key)
    typed = F.lower(F.coalesce("type_desc", F.lit(""))).contains((type_filter or "").lower())
    if filter_first:
        rows = rows.filter(typed)
    page = search.page(rows.orderBy("tier", "pos", *key), limit, offset)
    return (page if filter_first else page.filter(typed)).select(*key, "type_desc", "tier", "pos")
