"""Roots, stems, terms, cards, their index and searches, glossary matches."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.functions import terms
from quarry.functions import text as T
from quarry.operators import cards, glossary, metadata_search, search
from quarry.sources import reports


def test_stems_and_terms():
    assert terms.query_stems("скидок") == ["скидок", "скидк"] and terms.query_stems("заказу") == ["заказ"] and terms.query_stems("расчета")[1] == "рассчет" and terms.query_stems("stock") == []
    assert terms.query_stems("почтовых") == ["почтов"] and terms.query_stems("дом") == ["дом"]
    assert terms.roots_of("зарезервировать") == ["зарез", "резер"] and terms.roots_of("склад") == [] and terms.roots_of("Warehouse") == []
    assert terms.query_terms("сколько должны пайщикам") == ["пайщик", "пайщи"] and terms.query_terms("где") == ["где"]
    assert terms.query_terms("Red widget") == ["red", "widget"] and terms.query_terms("") == [] and len(terms.query_terms(" ".join(f"word{i:02}x" for i in range(40)))) == 24
    assert "отпра" in terms.query_terms("отправление товара") and not any(t != "отпра" and t.startswith("отпра") for t in terms.query_terms("отправление товара"))


def test_roots_as_columns(spark):
    words = ["зарезервировать", "отправление", "склад", "Перечисление", "warehouse", "", "поддержка", "выполненный"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", terms.word_roots(F.col("w")).alias("r")).collect()
    assert {r.w: r.r for r in rows} == {w: terms.roots_of(w) for w in words}


def plain_chunks(lines, limit):
    pieces = [(i + 1, line[a : a + limit]) for i, line in enumerate(lines) for a in (range(0, len(line), limit) or [0])]
    out, group, size = [], [], 0
    for n, p in pieces:
        if group and size + len(p) + 1 > limit:
            out.append((group[0][0], group[-1][0], "\n".join(x for _, x in group)))
            group, size = [], 0
        group.append((n, p))
        size += len(p) + 1
    return out + ([(group[0][0], group[-1][0], "\n".join(x for _, x in group))] if group else [])


def test_chunks_lose_nothing(spark):
    texts = ["", "a", "a\nb\nc", "x" * 95, "\n\n\n", "é" * 41 + "\nshort\n" + "y" * 20, "one two\n" * 60]
    for limit in (10, 40):
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.chunk_lines(F.split("t", "\n", -1), limit).alias("c")).collect()
        for r in rows:
            assert [(c.first, c["last"], c.text) for c in r.c] == plain_chunks(r.t.split("\n"), limit)


def test_cards(spark):
    procedures = spark.createDataFrame(
        [(1, "main", "Справочник.Склады.МодульОбъекта", "ЗаписатьСклад", "procedure", True, 2, 4, "&AtServer", "Procedure ЗаписатьСклад() Export", "Public", "Пишет склад."), (2, "ext", "Stock", "Count2", "function", False, 1, 2, "", "", "", "")],
        "proc_id long, source_id string, module string, procedure string, kind string, is_export boolean, start_line int, end_line int, directive string, signature string, region string, comment string",
    )
    modules = spark.createDataFrame([("main", "Справочник.Склады.МодульОбъекта", "//\nProcedure ЗаписатьСклад() Export\n  A();  \nEndProcedure")], "source_id string, module string, text string")
    known = spark.createDataFrame([("ext", "Справочник.Склады", "Места хранения"), ("main", "Справочник.Склады", "")], "source_id string, object string, synonym string")
    found = cards.cards(procedures, modules, known, limit=30).orderBy("proc_id", "chunk_no").collect()
    first = found[0]
    assert first.head.split("\n") == ["&AtServer Procedure ЗаписатьСклад() Export", "words: записать склад | склады", "roots: запис", "module: Справочник.Склады.МодульОбъекта", "object: Справочник.Склады - Места хранения", "region: Public", "about: Пишет склад."]
    assert [(r.start_line, r.end_line) for r in found if r.proc_id == 1][0] == (2, 2) and "\n".join(r.body for r in found if r.proc_id == 1).replace("\n", "") == "Procedure ЗаписатьСклад() Export  A();EndProcedure"
    assert found[-1].proc_id == 2 and found[-1].body == "" and found[-1].head.startswith("function Count2()\nwords: count 2") and first.content_hash.startswith("sha256:")
    post = cards.index(cards.cards(procedures, modules, known, limit=30))
    called = spark.createDataFrame([(1, 3)], "proc_id long, callers long")
    hit = cards.search_cards(post, None, procedures, called, "записать склады", terms.query_terms("записать склады"), limit=5).collect()
    assert [(r["rank"], r.proc_id, r["match"]) for r in hit] == [(1, 1, "fts")]
    exact = cards.search_cards(post, None, procedures, called, "count2", ["count2", "count"], glossary=[1], limit=5).collect()
    assert [(r.proc_id, r["match"]) for r in exact] == [(1, "glossary"), (2, "exact_name")]
    stored = spark.createDataFrame([("m", "a", "s", 1), ("m", "b", "old", 1)], "source_id string, module string, synonym string, card_format int")
    now = spark.createDataFrame([("m", "a", "s", 1), ("m", "b", "new", 1), ("m", "c", "", 1)], "source_id string, module string, synonym string, card_format int")
    assert {r.module for r in cards.stale(stored, now).collect()} == {"b", "c"}


def plain_bm25(docs, queries, weights):
    tokens = {k: {f: re.findall(r"\w+", v.lower()) for f, v in fields.items()} for k, fields in docs.items()}
    size = {k: sum(map(len, f.values())) for k, f in tokens.items() if sum(map(len, f.values()))}
    mean, out = sum(size.values()) / len(size), defaultdict(float)
    for t in queries:
        hits = {k: sum(weights[f] * sum(x.startswith(t) for x in xs) for f, xs in fs.items()) for k, fs in tokens.items()}
        hits = {k: v for k, v in hits.items() if v}
        idf = max(math.log((len(size) - len(hits) + 0.5) / (len(hits) + 0.5)), 1e-6) if hits else 0
        for k, f in hits.items():
            out[k] += idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size[k] / mean))
    return dict(out)


def test_index_and_scan_agree(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(80).select("doc_id", "text", "source").persist()
    wanted = ["tion", "er", "src1", "zzz"]
    weights = {"text": 1.0, "source": 5.0}
    plain = plain_bm25({r.doc_id: {"text": r.text or "", "source": r.source or ""} for r in docs.collect()}, wanted, weights)
    post = search.postings(docs, "doc_id", {"text": "text", "source": "source"})
    search.write_index(post, str(tmp_path / "index"))
    stored = spark.read.parquet(str(tmp_path / "index"))
    assert {tuple(r) for r in stored.collect()} == {tuple(r) for r in post.collect()}
    for scored in (search.scan_bm25(docs, "doc_id", {"text": "text", "source": "source"}, wanted, weights), search.bm25_terms(stored, search.lengths(stored, "doc_id"), "doc_id", wanted, weights)):
        assert {r.doc_id: r.score for r in scored.collect()} == pytest.approx(plain)
    counted = Counter(t for r in docs.collect() for t in set(re.findall(r"\w+", (r.text or "").lower())))
    assert {r.token: r.df for r in search.document_frequencies(docs, "text").collect()} == dict(counted)
    both = {r.doc_id: r.hits for r in search.scan_all(docs, "doc_id", {"text": "text"}, ["er", "an"]).collect()}
    assert both == {r.doc_id: r.hits for r in search.match_all(search.hits(post.filter("field = 'text'"), "doc_id", ["er", "an"]), "doc_id", 2).collect()}


def test_search_objects(spark):
    rows = [("Документ.Поля", "m", "Документ", "Поля", "", ""), ("Справочник.схПоля", "m", "Справочник", "схПоля", "Поля", ""), ("Документ.ПоступлениеТоваровУслуг", "m", "Документ", "ПоступлениеТоваровУслуг", "", ""), ("Отчет.ПоступлениеТоваров", "m", "Отчет", "ПоступлениеТоваров", "", ""), ("Справочник.Other", "m", "Справочник", "Other", "товары поступление", "поля")]
    known = spark.createDataFrame(rows, "object string, source_id string, kind string, name string, synonym string, comment string")
    names = lambda q, **k: [(r.object.split(".")[1], r.tier) for r in metadata_search.search_objects(known, q, **k).collect()]
    assert names("поля")[:3] == [("Поля", 0), ("схПоля", 0), ("Other", 3)]
    found = names("поступление товаров", glossary=["Справочник.Other"])
    assert found == [("Other", 1), ("ПоступлениеТоваров", 2), ("ПоступлениеТоваровУслуг", 2)]
    assert names("otherwise") == [("Other", 5)] and names("совсем ничего") == [] and names("поля", limit=1, offset=1) == [("схПоля", 0)]
    attributes = spark.createDataFrame([("Справочник.Other", "m", "Цена", "Реквизит", "Число(10, 2)", "цена продажи", ""), ("Документ.Поля", "m", "Сумма", "Реквизит", "Число", "", "")], "object string, source_id string, attribute string, kind string, type_desc string, synonym string, comment string")
    forms = spark.createDataFrame([("Справочник.Other.Форма.F", "m", "ЦенаФормы", "", "Строка")], "form string, source_id string, attribute string, title string, type_desc string")
    hit = lambda q, **k: [(r.attribute, r.tier) for r in metadata_search.search_attributes(known, attributes, q, forms, **k).collect()]
    assert hit("цена") == [("Цена", 1), ("ЦенаФормы", 2)] and hit("цена", glossary=[("Документ.Поля", "Сумма")])[0] == ("Сумма", 0)
    assert hit("цена", type_filter="строка", limit=1) == [] and hit("цена", type_filter="строка", limit=1, filter_first=True) == [("ЦенаФормы", 2)] and hit("") == []
    assert metadata_search.ranked_objects(known, attributes, None, "").count() == 0


def plain_same(a, b):
    keys = lambda w: {w, *terms.query_stems(w), *terms.roots_of(w)}
    return any(x == y or min(len(x), len(y)) >= 4 and (x.startswith(y) or y.startswith(x)) for x in keys(a) for y in keys(b))


def test_glossary_matches(spark):
    entries = [("1", "Справочник.Склады", "object", ["место хранения", "амбар"]), ("2", "Документ.Заказ", "object", ["заказы покупателей"]), ("3", "M.P", "procedure", ["red widget"]), ("4", "X", "object", ["где"]), ("5", "Y", "object", [])]
    rows = spark.createDataFrame(entries, "id string, target string, target_kind string, terms array<string>")
    for query in ("где места хранения", "заказ покупателя", "red widgets", "амбары", "ничего", "", "где"):
        found = {(r.id, r.term) for r in glossary.matches(rows, query).collect()}
        words = [w for w in re.findall(r"\w+", query) if len(w) > 1]
        words = [w for w in words if len(w) > 2 and w not in terms.QUESTION_WORDS] or words
        wanted = {(i, t) for i, _, _, ts in entries for t in ts if words and all(any(plain_same(w, q) for q in words) for w in t.split())}
        assert found == wanted, query
    assert [r.id for r in glossary.matches(rows, "red widget", ["object"]).collect()] == []


def test_pages_of_text(spark):
    rows = spark.createDataFrame([(i, f"n{i}") for i in range(7)], "i int, n string").orderBy("i")
    assert reports.page_text(rows, ["n"], 3, 3).split("\n") == ["4. n3", "5. n4", "6. n5", "Next page: offset=6"] and reports.page_text(rows.filter("i > 9"), ["n"], 3) == "Nothing found"
    assert [search.with_more(rows, 3, 4)[k] for k in (1, 2)] == [False, False] and search.with_more(rows, 900)[2]
    lines = [r.line for r in reports.markdown_lines(rows.filter("i < 2").withColumn("x", F.lit("a|b\nc")), "Title", "note").collect()]
    assert lines[0] == "# Title" and lines[-1] == "| 1 | n1 | a\\|b c |"
    assert search.canonical_kind("catalog", {"Catalog": "Справочник"}) == "Справочник" and search.canonical_kind("справочник", {"Catalog": "Справочник"}) == "Справочник" and search.canonical_kind("?", {}) == "?"
