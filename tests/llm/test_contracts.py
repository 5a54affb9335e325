"""The registered queries against plain versions, on the smallest tables and on awkward rows."""

import re
import sys
from collections import defaultdict
from pathlib import Path
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from quarry.llm import chat, exact_dedup, fingerprint, lm_scoring, mixing, near_dedup, pii, quality, recurrent, sentencepiece_bpe, urls  # noqa: E402
from quarry.llm.queries import QUERIES  # noqa: E402

TEXTS = [
    "", None, " \t\n", "a", "a b", "A  b", "mail x.y+z@mail.example.com, call +1 (743) 555-3824 or 4111 1111 1111 1111 from 10.0.300.1 and 10.0.255.1",
    "a@b.c%d@e.f 1.2.3.4.5.6.7.8 +1+22 333 444 5555", "▁ odd\x00\ufeff 𝒳𝒴 \x85\xa0", "word " * 3000 + "end", "same line\n" * 40, "x" * 40_000, "é" * 33_000 + " tail",
    "", "",
]


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty, blank, giant and repeated texts, null ids and sources, and columns whose names clash."""
    rows = [(i, t, None if i % 4 == 0 else f"s{i % 3}", 7, "q") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, statistics int, row string")


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()
    return {r.doc_id: r.text or "" for r in rows}, {r.doc_id: r.source for r in rows}


def empty(frame):
    return frame.filter("false")


def by_id(frame):
    return {r[0]: r for r in frame.collect()}


def check_fingerprints(rows, texts):
    edited = brute.edits(texts)
    prints = defaultdict(set)
    for i, r in rows.items():
        assert r.n_chars == len(texts[i]) and r.edited_sha256 == brute.sha(edited[i])
        prints[texts[i]].add(r.fingerprint)
        prints[edited[i]].add(r.edited_fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.near_edited == 1) if edited[i] == texts[i] else r.fingerprint != r.edited_fingerprint
    assert all(len(p) == 1 for p in prints.values()) and len({p for s in prints.values() for p in s}) == len(prints)


def test_fingerprints(spark, sf_dir, texts, awkward):
    rows = by_id(QUERIES["op1_fingerprints"](spark, sf_dir))
    check_fingerprints(rows, texts[0])
    assert sum(r.near_edited > r.near_next for r in rows.values()) > 0.9 * len(rows)
    check_fingerprints(by_id(fingerprint.compare_with_edits(awkward)), {i: t or "" for i, t in enumerate(TEXTS)})
    assert empty_count(fingerprint.compare_with_edits, awkward) == 0
    far = spark.createDataFrame([(5, "a" * 9), (10_000_000, "b" * 9), (-70, "c" * 9)], "doc_id long, text string")
    check_fingerprints(by_id(fingerprint.compare_with_edits(far)), {5: "a" * 9, 10_000_000: "b" * 9, -70: "c" * 9})
    nulls = spark.createDataFrame([(None, "a"), (None, "b"), (1, "c")], "doc_id long, text string")
    assert fingerprint.compare_with_edits(nulls).count() == 3


def test_merkle_branches(spark):
    pair = spark.createDataFrame([("one\ntwo\n\nthree\nfour", "one\ntwo\n\nthree\nFOUR")], "a string, b string")
    tree = lambda c: fingerprint.branches(fingerprint.fingerprint(F.col(c)))
    found = pair.select(fingerprint.differing_paragraphs(tree("a"), tree("b")).alias("d")).first().d
    assert [(x.section, x.paragraph) for x in found] == [(1, 1)]


def plain_tree(text):
    """root/sections/stretches of a text, without Spark."""
    import xxhash

    # As the Java split: at every place where the pattern fits, also at the end.
    cut = lambda t, pattern: re.split(pattern, t)
    sections = [cut(s, r"(?<=\n)(?!\n?\Z)") for s in cut(text, r"(?<=\n\n)(?!\n)")]
    leaves = [[brute.sha(p) for p in s] for s in sections]
    tops = [brute.sha("".join(x)) for x in leaves]
    short = lambda x: f"{xxhash.xxh64_intdigest(x.encode(), 42) & 0xFFFFFFFF:08x}"
    stretches = ["".join(short(x) for x in re.findall(r"[^\n]{1,48}", p)) for s in sections for p in s]
    return "/".join([brute.sha("".join(tops)), "|".join(";".join([t[:16], *(x[:16] for x in s)]) for t, s in zip(tops, leaves, strict=True)), ";".join(stretches)])


def plain_likeness(a, b):
    (x, _, p), (y, _, q) = a.split("/"), b.split("/")
    if x == y:
        return 1.0
    p, q = (set(re.findall("[0-9a-f]{8}", t)) for t in (p, q))
    return 2 * len(p & q) / (len(p) + len(q)) if p or q else 0.0


def test_fingerprints_equal_a_plain_tree(spark, sf_dir, texts):
    """Fingerprint, likeness and changed paragraphs of a whole table, by a plain version; likeness is of fingerprints alone."""
    edited = brute.edits(texts[0])
    order = sorted(texts[0], reverse=True)
    following = dict(zip(order, order[1:] + order[:1], strict=True))
    for i, r in by_id(QUERIES["op1_fingerprints"](spark, sf_dir)).items():
        own, other, after = (plain_tree(t) for t in (texts[0][i], edited[i], texts[0][following[i]]))
        assert (r.fingerprint, r.edited_fingerprint) == (own, other)
        assert r.near_edited == pytest.approx(plain_likeness(own, other)) and r.near_next == pytest.approx(plain_likeness(own, after))
        assert (r.n_changed == 0) == (own.split("/")[0] == other.split("/")[0] or len(other) > len(own) and own.split("/")[1] in other)


def test_blocks_split_any_ids(spark):
    """However ids are spread, blocks are small; null ids are split by their texts."""
    for ids in ([i * 10**15 for i in range(3000)], list(range(2999)) + [10**18], [None] * 2000 + list(range(1000))):
        docs = spark.createDataFrame([(x, k) for k, x in enumerate(ids)], "doc_id long, n long").withColumn("text", F.col("n").cast("string")).withColumn("h", F.xxhash64("text"))
        sizes = [r["count"] for r in docs.groupBy(fingerprint.blocks_of(docs)).count().collect()]
        assert max(sizes) < 3 * fingerprint.BLOCK_DOCS and sum(sizes) == 3000


def empty_count(operator, frame, *args):
    return operator(empty(frame), *args).count()


def check_mixing(rows, sizes, sources):
    by_source = defaultdict(int)
    for i, n in sizes.items():
        by_source[sources[i]] += n
    target = brute.targets(by_source)
    took = defaultdict(int)
    for r in rows.values():
        assert r.size == sizes[r.doc_id] and r.source_size == by_source[sources[r.doc_id]] and r.taken <= 3 * r.size
        assert r.target == pytest.approx(target[sources[r.doc_id]])
        took[sources[r.doc_id]] += r.taken
    assert all(abs(took[s] - t) <= 1 for s, t in target.items())


def test_mixing(spark, sf_dir, texts, awkward):
    sizes = {i: len(brute.WORD.findall(t)) for i, t in texts[0].items()}
    rows = by_id(QUERIES["op2_source_mixing"](spark, sf_dir))
    check_mixing(rows, sizes, texts[1])
    assert rows == by_id(QUERIES["op2_source_mixing"](spark, sf_dir))
    check_mixing(by_id(mixing.mix_report(awkward)), {i: len(brute.WORD.findall(t or "")) for i, t in enumerate(TEXTS)}, {r.doc_id: r.source for r in awkward.collect()})
    assert empty_count(mixing.mix_report, awkward) == 0 and empty_count(mixing.mix_documents, awkward) == 0
    blank = awkward.filter("trim(text) = ''")
    assert {r.taken for r in mixing.mix_report(blank).collect()} == {0}


def test_mixed_documents_hold_the_words_taken(awkward):
    taken = {r.doc_id: r.taken for r in mixing.mix_report(awkward).collect()}
    held = defaultdict(int)
    out = mixing.mix_documents(awkward)
    assert out.columns == awkward.columns
    for r in out.collect():
        held[r.doc_id] += len(brute.WORD.findall(r.text))
    assert {i: n for i, n in taken.items() if n} == dict(held)


def test_shards_of_the_mixture_are_multinomial(spark):
    """Every slot is in one output shard, by counts that fit the multinomial; the shards together are the mixture."""
    plan = mixing.source_plan(spark.createDataFrame([(1, "a", 90_000, 1.0, 150_000.0), (2, "b", 60_000, 2.0, 100_000.0)], "sid long, source string, source_size long, weight double, target double"), 8)
    drawn = mixing.draws(plan, 8, shard_slots=1500).collect()
    counts = mixing.shard_counts(mixing.slots(mixing.draws(plan, 8, shard_slots=1500), 8)).collect()
    assert {(r.shard, r.sid): r.slots for r in drawn}.keys() >= {(r.shard, r.sid) for r in counts}
    total, shards = defaultdict(int), {r.shard for r in counts}
    for r in counts:
        total[r.sid] += r.slots
    assert len(shards) == 32 and len(counts) == 64 and sum(r.words for r in counts) == 250_000
    chi = sum((r.slots - total[r.sid] / 32) ** 2 / (total[r.sid] / 32) for r in counts)
    assert 30 < chi < 105  # 62 degrees of freedom
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(500)), f"s{i % 2}") for i in range(1200)], "doc_id long, text string, source string")
    found, taken = mixing.mix_shards(docs).collect(), {r.doc_id: r.taken for r in mixing.mix_report(docs).collect()}
    held = defaultdict(int)
    for r in found:
        held[r.doc_id] += r["last"] - r["first"]
    assert len({r.shard for r in found}) == 4 and held == {i: n for i, n in taken.items() if n}


def test_mixture_hangs_on_values_alone(spark, sf_dir, tmp_path):
    """The same rows in other files and another order give the same mixture."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.orderBy(F.desc("text")).repartition(7).write.parquet(str(tmp_path / "documents.parquet"))
    assert by_id(QUERIES["op2_source_mixing"](spark, str(tmp_path))) == by_id(QUERIES["op2_source_mixing"](spark, sf_dir))
    same = lambda d: sorted((r.doc_id, r.text) for r in mixing.mix_documents(d).collect())
    assert same(docs) == same(spark.read.parquet(str(tmp_path / "documents.parquet")))


def test_repeated_rows_are_each_mixed(spark):
    rows = [(1, "a b c d", "x")] * 5 + [(2, "e f", "y"), (None, "g h", None), (None, "g h", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, held = sum(r.taken for r in mixing.mix_report(docs).collect()), [len(r.text.split()) for r in mixing.mix_documents(docs, 3).collect()]
    assert taken == 26 and sum(held) == 26


def test_halving_draws_are_binomial(spark):
    for n in (1, 63, 64, 65, 1000, 4096, 4097, 10**9):
        found = [r.d for r in spark.range(4000).select(mixing.half_of(F.lit(n).cast("long"), F.col("id")).alias("d")).collect()]
        assert 0 <= min(found) and max(found) <= n
        assert abs(np.mean(found) - n / 2) < 4 * np.sqrt(n / 4 / 4000) and 0.9 < np.var(found) / (n / 4) < 1.1


def test_permutation_is_exact(spark):
    for n in (1, 2, 7, 64, 1000):
        image = mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long"))
        back = mixing.permuted(F.col("p"), F.lit(n).cast("long"), F.lit(5).cast("long"), inverse=True)
        rows = spark.range(n).withColumn("p", image).withColumn("q", back).collect()
        assert sorted(r.p for r in rows) == list(range(n)) and all(r.q == r.id for r in rows)


def test_personal_data(spark, sf_dir, texts, awkward):
    for found, expected in ((QUERIES["op3_personal_data"](spark, sf_dir), texts[0]), (pii.find(awkward), {i: t or "" for i, t in enumerate(TEXTS)})):
        for i, r in by_id(found).items():
            counts, spans = brute.personal(expected[i])
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts and r.base_sha256 == brute.sha(spans), i
            assert set(filter(None, spans.split(","))) <= set(r.spans.split(",")) and len(list(filter(None, r.spans.split(",")))) == sum(counts) + r.n_added
    assert empty_count(pii.find, awkward) == 0


def test_contexts_discover_identifiers(spark):
    rows = [(i, f"please ring phone: +1 (743) 555-{1000 + i} today") for i in range(9)] + [(50, "please ring phone: 743-555-9999, today"), (51, "in the year 1999 we met")]
    found = by_id(pii.find(spark.createDataFrame(rows, "doc_id long, text string")))
    assert found[50].spans == "phone:19:31" and found[50].n_phone == 0 and found[51].spans == ""


def test_secrets_and_contexts_on_both_sides(spark):
    """Of planted identifiers that no base pattern fits all are found, by what stands around them, and nothing else is."""
    hexes = [f"{i:02x}ab" + "0f" * 18 for i in range(9)]
    rows = [(i, f'some words token = "{h}" and more') for i, h in enumerate(hexes)] + [(20 + i, f"the {i}{i} lines of text no {i}") for i in range(9)]
    rows += [(30, f'x token = "{hexes[0]}"### 4785380592 y'), (40, 'a token = "short-1234" here'), (41, "mail x at 17 o'clock")]
    rows += [(50 + i, f"write to user{i}@mail.example.com for news") for i in range(9)] + [(70, "write to user@localhost for news")]
    found = by_id(pii.find(spark.createDataFrame(rows, "doc_id long, text string")))
    assert all(found[i].spans == f"secret:20:{20 + len(h)}" for i, h in enumerate(hexes)) and all(found[20 + i].n_spans == 0 for i in range(9))
    assert found[30].spans == f"secret:11:{11 + len(hexes[0])}"
    assert found[40].spans == "secret:11:21" and found[41].spans == "" and found[70].spans == "email:9:23" and found[70].n_email == 0
    long = "word " * 30_000 + "+1 (743) 555-1234 " * 3_000
    one = pii.find(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert one.n_phone == len(brute.personal(long)[1].split(",")) == 3000


def test_quality(spark, sf_dir, awkward):
    rows = by_id(QUERIES["op4_quality_rules"](spark, sf_dir.replace("0.001", "0.01")))
    labels = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/labels.parquet").collect()
    held = [x for x in labels if crc32(str(x.doc_id).encode()) % 4 == 2]
    assert all(rows[x.doc_id].held_out for x in held)
    assert sum(rows[x.doc_id].predicted == x.quality for x in held) >= 0.93 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows.values())
    marks = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    assert quality.classify(awkward, marks).count() == len(TEXTS) and empty_count(quality.classify, awkward, marks) == 0
    assert {r.score for r in quality.classify(awkward, marks.filter("false")).collect()} == {0.5}
    assert quality.keep_good(awkward, marks).columns == awkward.columns


def test_language_model(spark, sf_dir, texts, awkward):
    base, known, n = brute.base_scores(texts[0])
    rows = by_id(QUERIES["op5_recurrent_lm"](spark, sf_dir))
    for i, r in rows.items():
        assert r.base_score == pytest.approx(base[i]) and r.n_known == known[i] and r.train_tokens == n
        assert r.n_tokens == len(brute.WORD.findall(texts[0][i])) + 1 and r.held_out == (crc32(str(i).encode()) % 7 == 2)
    # Logarithms: the higher, the likelier; the untrained model is about the unigram.
    assert sum(r.score for r in rows.values() if r.held_out) > sum(r.base_score for r in rows.values() if r.held_out)
    base, known, n = brute.base_scores({i: t or "" for i, t in enumerate(TEXTS)})
    for i, r in by_id(lm_scoring.score_documents(awkward)).items():
        assert r.base_score == pytest.approx(base[i]) and r.n_known == known[i] and r.score < 0
    assert empty_count(lm_scoring.score_documents, awkward) == 0


def test_language_model_learns_from_every_training_document(spark):
    """One shard's weights are those of all its documents, down to the last words of a few short ones."""
    for n in (3, 60):
        rows = [(i, f"word{i} follows word{i + 1} and then ends") for i in range(n)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", F.lit(False))
        counts = lm_scoring.count_words(docs).orderBy(F.desc("n"), "word").collect()
        head, head_n = (np.array([r[c] for r in counts]) for c in ("word", "n"))
        masses = np.ones(recurrent.SIDE**2)
        start = recurrent.initial(head_n + 1.0, masses)
        ranks = {w: i for i, w in enumerate(head.tolist())}
        ids = [np.array([ranks[t] for t in lm_scoring.tokens([text.encode()])[0].tolist()]) for _, text in rows]
        units = lm_scoring.as_units(docs, head, head_n, masses)
        assert [np.frombuffer(r.units, "<u2").tolist() for r in units.orderBy("doc_id").collect()] == [x.tolist() for x in ids]
        found, wanted = lm_scoring.train_model(units, start, n), recurrent.train(start, ids)
        assert all(np.allclose(found[k], wanted[k], atol=1e-5) for k in start)
        last = recurrent.train(start, [*ids[:-1], np.append(ids[-1][:-1], ids[0][0])])
        assert any((wanted[k] != start[k]).any() for k in start) and any((wanted[k] != last[k]).any() for k in start)


def test_language_model_weights_are_a_mean_of_shards(spark, monkeypatch):
    """Whatever the tree by which they are added up."""
    monkeypatch.setattr(lm_scoring, "SHARD_DOCS", 7)
    rng = np.random.default_rng(3)
    start = recurrent.initial(np.ones(200), np.ones(recurrent.SIDE**2))
    docs = [(i, rng.integers(0, 200, 30).astype("<u2").tobytes()) for i in range(100)]
    units = spark.createDataFrame([(i, bytearray(x)) for i, x in docs], "doc_id long, units binary")
    found = lm_scoring.train_model(units, start, 100)
    parts = defaultdict(list)
    for r in units.select("doc_id", "units", F.pmod(F.hash(F.xxhash64("doc_id")), F.lit(15)).alias("shard")).collect():
        parts[r.shard].append((r.doc_id, bytes(r.units)))
    trained = [recurrent.train(start, [np.frombuffer(x, "<u2") for _, x in sorted(p)]) for p in parts.values()]
    sizes = [sum(len(x) for _, x in p) for p in parts.values()]
    assert all(np.allclose(found[k], sum(t[k] * n for t, n in zip(trained, sizes, strict=True)) / sum(sizes), atol=1e-4) for k in start)


def plain_score(p, tokens):
    """log10-likelihood of a document's units, word by word, by the definition of the cell and of the softmax."""
    side, h, before, total = p["w"].shape[1], np.zeros(recurrent.HIDDEN), len(p["x"]) - 1, 0.0
    for t in tokens:
        gh, gx = h @ p["u"].astype("f8"), p["x"][before].astype("f8")
        f = 1 / (1 + np.exp(-(gh[: recurrent.HIDDEN] + gx[: recurrent.HIDDEN])))
        h = (1 - f) * h + f * np.tanh(gx[recurrent.HIDDEN :] + f * gh[recurrent.HIDDEN :])
        o = np.append(h, 1.0)
        for logits, at in ((p["c"] @ o, t // side), (p["w"][t // side] @ o, t % side)):
            total += logits[at] - np.log(np.exp(logits - logits.max()).sum()) - logits.max()
        before = t
    return total / np.log(10)


def test_language_model_scores_whole_documents_in_streams():
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 700, n) for n in (1, 700, 3, 40, 0, 1, 90, 33)]
    p = recurrent.train(recurrent.initial(rng.integers(1, 9, 700) + 0.0, np.ones(recurrent.SIDE**2)), docs)
    for streams in (1, 3, 256):
        assert recurrent.score(p, docs, streams) / np.log(10) == pytest.approx([plain_score(p, d) for d in docs], rel=1e-4, abs=1e-6)


def test_language_model_gradients_are_right():
    """Against differences of the loss, for weights of every kind."""
    rng = np.random.default_rng(2)
    p = recurrent.initial(rng.integers(1, 9, 60) + 0.0, np.ones(recurrent.SIDE**2))
    inputs, targets = rng.integers(0, 60, (6, 5)).astype(np.int32), rng.integers(0, 60, (6, 5))
    targets[2, 1] = -1
    h0 = np.zeros((5, recurrent.HIDDEN), "f4")

    def loss(q):
        h, total = h0, 0.0
        for x, y in zip(inputs, targets, strict=True):
            h = recurrent.step(q["u"], q["x"][x], h)[0]
            live = y >= 0
            total -= recurrent.log_probs(q, np.append(h, np.ones((5, 1), "f4"), axis=1)[live], y[live]).sum()
        return total

    found, _ = recurrent.gradients(p, inputs, targets, h0)
    for k in p:
        full = np.zeros_like(p[k])
        full[found[k][0]] = found[k][1]
        for at in np.argsort(-np.abs(full).ravel())[:4]:
            up, down = ({x: v.copy() for x, v in p.items()} for _ in range(2))
            up[k].ravel()[at] += 0.02
            down[k].ravel()[at] -= 0.02
            assert full.ravel()[at] == pytest.approx((loss(up) - loss(down)) / 0.04, rel=0.05), k


def test_language_model_reads_and_predicts_rare_words(spark):
    """Of two rare words, equally frequent, the model learns what follows which; its units grow with the vocabulary."""
    assert recurrent.side_of(100) == recurrent.SIDE and recurrent.side_of(10**8) > 2 * recurrent.side_of(10**6)
    train, held = ([i for i in range(4000) if (crc32(str(i).encode()) % 7 == 2) == h] for h in (False, True))
    common = " ".join(f"c{i} c{i}" for i in range(1200))
    rows = [(i, f"rare{k % 2} follows{k % 2} " * 40) for k, i in enumerate(train[:200])] + [(i, " ".join([common] * 21)) for i in train[200:300]]
    rows += [(held[0], "rare0 rare0 rare0 rare0"), (held[1], "rare1 rare1 rare1 rare1"), (held[2], "rare0 follows0"), (held[3], "rare0 follows1")]
    out = by_id(lm_scoring.score_documents(spark.createDataFrame(rows, "doc_id long, text string")))
    assert out[held[2]].base_score == pytest.approx(out[held[3]].base_score) and out[held[2]].score > out[held[3]].score + 0.1
    assert out[held[0]].base_score == pytest.approx(out[held[1]].base_score) and out[held[0]].score != pytest.approx(out[held[1]].score, abs=1e-9)


def leafy(side=4, leaves=6):
    """Weights after some training, and documents, of a small model whose buckets have several units."""
    rng = np.random.default_rng(6)
    p = recurrent.initial(rng.integers(1, 9, side**2) + 0.0, rng.integers(1, 9, (side**2, leaves)) + 0.0)
    docs = [rng.integers(0, side**2 * (1 + leaves), n) for n in (400, 3, 90, 1, 250)]
    return recurrent.train(p, docs), docs


def test_language_model_learns_units_within_buckets():
    """Probabilities of all units sum to one, and gradients are those of the loss, for the units of buckets too."""
    p, docs = leafy()
    units, side, leaves = np.arange(16 * 7), 4, 6
    h = np.random.default_rng(7).normal(0, 1, (5, recurrent.HIDDEN)).astype("f4")
    states = np.append(h, np.ones((5, 1), "f4"), axis=1)
    every = np.exp([recurrent.log_probs(p, np.tile(x, (len(units), 1)), units) for x in states])
    assert every.sum(axis=1) == pytest.approx(np.ones(5), abs=1e-4) and np.abs(every[0] - every[1]).max() > 1e-4
    rng = np.random.default_rng(9)
    inputs, targets = rng.integers(0, len(units), (6, 5)).astype(np.int32), rng.integers(0, len(units), (6, 5))
    targets[:, 2] = 16 + 3 * leaves + np.array([0, 1, 1, 1, 5, 5])

    def loss(q):
        state, total = h, 0.0
        for x, y in zip(inputs, targets, strict=True):
            state = recurrent.step(q["u"], q["x"][x], state)[0]
            total -= recurrent.log_probs(q, np.append(state, np.ones((5, 1), "f4"), axis=1), y).sum()
        return total

    found, _ = recurrent.gradients(p, inputs, targets, h)
    for k in p:
        full = np.zeros_like(p[k])
        full[found[k][0]] = found[k][1]
        for at in np.argsort(-np.abs(full).ravel())[:4]:
            up, down = ({x: v.copy() for x, v in p.items()} for _ in range(2))
            up[k].ravel()[at] += 0.02
            down[k].ravel()[at] -= 0.02
            assert full.ravel()[at] == pytest.approx((loss(up) - loss(down)) / 0.04, rel=0.05), k
    assert recurrent.unpack(recurrent.pack(p), side, leaves)["v"] == pytest.approx(p["v"])


class Read(np.ndarray):
    """Weights of buckets that note how many of their rows are read."""

    noted: list[int] = []

    def __getitem__(self, at):
        if len(self) == 16 and self.ndim == 3 and not isinstance(at, slice | tuple):
            Read.noted.append(np.size(at))
        return super().__getitem__(at)

    def take(self, at, axis=None):
        Read.noted.append(np.size(at))
        return np.asarray(self).take(at, axis=axis)


def test_language_model_reads_a_bucket_once(monkeypatch):
    """In a window and in a block of scoring, however many of its targets are the bucket's (F1)."""
    p, _ = leafy()
    rng = np.random.default_rng(10)
    inputs, targets = rng.integers(0, 112, (6, 400)).astype(np.int32), rng.integers(0, 112, (6, 400))
    p["v"] = p["v"].view(Read)
    monkeypatch.setattr(Read, "noted", [])
    recurrent.gradients(p, inputs, targets, np.zeros((400, recurrent.HIDDEN), "f4"))
    assert 0 < sum(Read.noted) <= 16
    Read.noted.clear()
    recurrent.log_probs(p, np.ones((2048, recurrent.OUT), "f4"), np.resize(targets, 2048))
    assert 0 < sum(Read.noted) <= 16


def test_language_model_scores_units_within_buckets(monkeypatch):
    """By the definition, whatever is taken at a time: blocks that part a bucket, rows fewer than streams, and no words."""
    p, _ = leafy()
    rng = np.random.default_rng(11)
    docs = [np.minimum(rng.geometric(0.02, n), 111) for n in (300, 0, 2, 90, 1, 41)]

    def plain(units):
        h, before, total = np.zeros((1, recurrent.HIDDEN), "f4"), len(p["x"]) - 1, 0.0
        for t in units.tolist():
            h = recurrent.step(p["u"], p["x"][[before]], h)[0]
            o, bucket = np.append(h, 1.0), (t - 16) // 6 if t >= 16 else None
            word = t if bucket is None else 16 + bucket
            parts = [(p["c"] @ o, word // 4), (p["w"][word // 4] @ o, word % 4)] + ([] if bucket is None else [(o @ p["v"][bucket], (t - 16) % 6)])
            total += sum(logits[at] - np.log(np.exp(logits).sum()) for logits, at in parts)
            before = t
        return total

    wanted = [plain(d) for d in docs]
    for block, rows, streams in ((2048, 1 << 17, 512), (7, 50, 3), (1, 1, 6)):
        monkeypatch.setattr(recurrent, "BLOCK", block)
        monkeypatch.setattr(recurrent, "ROWS", rows)
        assert recurrent.score(p, docs, streams) == pytest.approx(wanted, rel=1e-4, abs=1e-6)


def test_most_words_are_units_of_their_own(spark):
    """Not the first thousand alone: 20,000 words of equal frequency have a unit each, which no other counted word has."""
    words = [f"w{i}" for i in range(20_000)]
    docs = spark.createDataFrame([(0, " ".join(words * 2)), (1, " ".join(f"rare{i}" for i in range(9_000)))], "doc_id long, text string").withColumn("held_out", F.lit(False))
    top = lm_scoring.count_words(docs).orderBy(F.desc("n"), "word").toPandas()
    head, head_n, side = top["word"].to_numpy(), top["n"].to_numpy(), recurrent.side_of(len(top))
    masses = lm_scoring.bucket_masses(lm_scoring.count_words(docs), head, head_n, side**2, side)
    units = np.frombuffer(lm_scoring.as_units(docs, head, head_n, masses).orderBy("doc_id").first().units, lm_scoring.unit_type(side**2 + masses.size))
    assert len(np.unique(units[:20_000])) == 20_000 and (units[:20_000] == units[20_000:40_000]).all()
    # Every counted word is in one mass: its count and one; each shared unit has one for words not counted.
    shared = side**2 * (side - lm_scoring.own_leaves(side))
    assert masses.sum() + (head_n[: side**2] + 1).sum() == head_n.sum() + len(head) + shared


def test_language_model_sums_to_one():
    rng = np.random.default_rng(1)
    p = recurrent.train(recurrent.initial(rng.integers(1, 9, 700) + 0.0, np.ones(recurrent.SIDE**2)), [rng.integers(0, 700, 500)])
    units = np.arange(2 * recurrent.SIDE**2)
    assert np.exp(recurrent.log_probs(p, np.tile(np.append(rng.normal(0, 1, recurrent.HIDDEN), 1.0).astype("f4"), (len(units), 1)), units)).sum() == pytest.approx(1, abs=1e-4)


def test_near_duplicates(spark, sf_dir, texts, awkward):
    for found, expected in ((QUERIES["op6_near_dedup"](spark, sf_dir), texts[0]), (near_dedup.near_groups(awkward, 3, 85), {i: t or "" for i, t in enumerate(TEXTS)})):
        groups = brute.near_components(expected, 3, 85)
        for i, r in by_id(found).items():
            assert r.component_id == groups[i] and r.kept == (groups[i] == i) and r.n_shingles == len(brute.shingles(expected[i], 3))
    assert empty_count(near_dedup.near_groups, awkward) == 0
    assert near_dedup.drop_near_copies(awkward).columns == awkward.columns


def test_chains_and_families(spark):
    """Links that no hub offers directly still join their documents."""
    rows, words = [], [f"w{i}" for i in range(200)]
    for i in range(60):
        w = list(words)
        for k in range(3):
            w[(i * 5 + k * 67) % 200] = f"x{i}"
        rows.append((i, " ".join(w)))
    for i in range(30):
        rows.append((100 + i, " ".join(f"c{j}" for j in range(i * 4, i * 4 + 60))))
    groups = brute.near_components(dict(rows), 3, 85)
    found = by_id(near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85))
    assert {i: r.component_id for i, r in found.items()} == groups


def test_sentencepiece_equals_the_library(spark, awkward):
    import hashlib

    import numpy as np
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.DEFAULT_MODEL)
    expected = {i: library.encode(t or "") for i, t in enumerate(TEXTS)}
    for size in (sentencepiece_bpe.CHUNK_CHARS, 4096):
        rows = by_id(sentencepiece_bpe.encode(awkward, ["doc_id"], chunk_chars=size))
        assert {i: np.frombuffer(r.ids, "<i4").tolist() for i, r in rows.items()} == expected
    report = by_id(sentencepiece_bpe.report(awkward))
    assert all(r.round_trip and r.n_tokens == len(expected[i]) and r.ids_sha256 == hashlib.sha256(np.array(expected[i], "<i4").tobytes()).hexdigest() for i, r in report.items())
    assert report[11].n_chunks == 2 and empty_count(sentencepiece_bpe.report, awkward) == 0


def test_transfer_matrices_settle_cuts_within_words(spark, texts):
    """Chunks of any size, cut anywhere, give the plain encoding."""
    import numpy as np

    bpe = sentencepiece_bpe.Bpe(sentencepiece_bpe.DEFAULT_MODEL)
    for text in [t for t in texts[0].values()][:6] + ["aaaaaaaabaaa  bcbcbcb   internationalisation" * 4]:
        whole = bpe.normal(text[:500])
        for size in (17, 40):
            cuts = [(a, min(len(whole), a + size)) for a in range(0, len(whole), size)]
            steps = [bpe.transfer(whole, a, b, b == len(whole)) for a, b in cuts]
            at = sentencepiece_bpe.settle([m for _, _, m in steps])
            ids = [bpe.trace(whole, a, b, ins[i], outs[o]) for (a, b), (ins, outs, _), (i, o) in zip(cuts, steps, at, strict=True)]
            assert np.concatenate(ids).tolist() == bpe.encode_many([whole])[0].tolist()


def test_exact_groups_of_awkward_rows(awkward):
    rows = by_id(exact_dedup.exact_groups(awkward))
    bare = {i: brute.SPACE.sub("", t or "") for i, t in enumerate(TEXTS)}
    for i, r in rows.items():
        mates = [j for j in bare if bare[j] == bare[i]]
        keep = min(mates, key=lambda j: (-len(TEXTS[j] or ""), j))
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (keep, len(mates), keep == i, brute.sha(bare[i]))
    assert empty_count(exact_dedup.exact_groups, awkward) == 0
    full = by_id(exact_dedup.exact_groups(awkward, max_bits=1 << 15))
    assert full == rows


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(1, "same  text"), (1, "same  text"), (None, "no id"), (None, "no id"), (None, "noid"), (2, "same text"), (2, "only here"), (None, long), (7, long + " tail"), (7, long + " tail"), (5, long + " end"), (5, "another one"), (None, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("q")).repartition(3)
    held = lambda f: sorted(((r.doc_id, r.text or "") for r in f.collect()), key=repr)
    exact = exact_dedup.drop_copies(docs)
    assert exact.columns == docs.columns
    assert held(exact) == sorted([(1, "same  text"), (None, "no id"), (2, "only here"), (None, long), (7, long + " tail"), (5, long + " end"), (5, "another one"), (None, "")], key=repr)
    near = near_dedup.drop_near_copies(docs)
    assert near.columns == docs.columns
    wide = [r for r in held(near) if len(r[1].split()) > 5]
    assert wide == [(5, long + " end")] and (5, "another one") in held(near) and (2, "only here") in held(near)


def test_urls(spark):
    cases = [
        ("http://a.example.net/en/x", "example.net/en/", "allow"), ("https://NET/y", "net/", "block"), ("http://x.example.com/de/1?q", "example.com/de/", "block"),
        ("http://b.org/fr/", "org/fr/", "allow"), ("http://example.net/fr", "net/", "block"), ("http://example.net", None, None), (None, None, None), ("no scheme/net/", None, None), ("http://morg/fr/", None, None), ("x://u@h.net:80/a://b", None, None), ("", None, None),
    ]
    rows = by_id(urls.filter_urls(spark.createDataFrame([(i, u, "q") for i, (u, _, _) in enumerate(cases)], "page_id long, url string, host string")))
    for i, (_, rule, verdict) in enumerate(cases):
        assert rows[i].rule == rule and rows[i].verdict in ({verdict} if rule else {"allow", "block"}), cases[i]
    assert (rows[1].host, rows[1].path, rows[5].path, rows[6].host, rows[9].host, rows[9].path) == ("net", "/y", "", "", "u@h.net:80", "/a://b")
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_entropy_is_of_the_whole_url(spark):
    cases = ["http://h.net/" + "a" * 600 + "0123456789bcdef" * 40, "é𝒳?" * 300, "", "aaaa"]
    found = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "i long, url string").select("i", urls.features(F.col("url"), F.lit(""), F.lit(""))[urls.FEATURES.index("entropy")].alias("e")).collect()
    for r in found:
        u = cases[r.i]
        assert r.e == pytest.approx(-sum(u.count(c) / len(u) * np.log2(u.count(c) / len(u)) for c in set(u)))


def test_chat_round_trip(spark):
    rows = [(1, 1, "assistant", "<|end|>&lt;[x]"), (1, 0, "user", None), (1, 2, "user", "<|turn|>"), (2, 0, "system", ""), (None, 5, None, "&amp;"), (3, 0, "assistant", "a"), (3, 0, "assistant", "a")]
    made = chat.prefix_targets(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = {r.conv_id: r for r in chat.read_back(made).collect()}
    assert found[1].turns_sha256 == brute.sha("user\n\nassistant\n<|end|>&lt;[x]\nuser\n<|turn|>\n") and found[1].loss_sha256 == brute.sha("<|end|>&lt;[x]") and found[1].loss_chars == 14
    assert (found[2].n_turns, found[2].loss_chars, found[3].n_examples, found[3].loss_chars) == (1, 0, 2, 2) and found[None].n_turns == 1
    examples = chat.explode_examples(made).filter("conv_id = 1").orderBy("example").collect()
    assert len(examples) == 2 and examples[1].formatted.startswith(examples[0].formatted) and examples[1].loss_first == examples[1].loss_last
    assert chat.prefix_targets(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_figures_are_read_from_written_examples(spark):
    """A rendering that lacks its end shows in the examples' lengths, which their offsets don't tell."""
    rows = [(1, i, "assistant" if i % 2 else "user", f"text {i}") for i in range(40)]
    made = chat.prefix_targets(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    sizes = [len(r.formatted) for r in chat.explode_examples(made).collect()]
    whole, cut = (chat.read_back(m).first() for m in (made, made.withColumn("formatted", F.expr("substring(formatted, 1, length(formatted) - 1)"))))
    assert (whole.n_examples, whole.formatted_chars, whole.loss_sha256) == (20, sum(sizes), brute.sha("".join(f"text {i}" for i in range(1, 40, 2))))
    assert cut.formatted_chars == whole.formatted_chars - 1


def test_pipeline_applies_each_decision(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, corpus_pipeline.materialize(stage(spark, kept, sf_dir), name)
        assert kept.columns == docs.columns
        if name == "quality":
            assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.classify(before, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("predicted = 1").collect()}
        if name in ("exact_dedup", "near_dedup"):
            texts = {r.doc_id: r.text for r in before.collect()}
            bare = defaultdict(list)
            for i, t in texts.items():
                bare[brute.SPACE.sub("", t)].append(i)
            wanted = {min(g, key=lambda j: (-len(texts[j]), j)) for g in bare.values()} if name == "exact_dedup" else set(brute.near_components(texts, 5, 80).values())
            assert {r.doc_id for r in kept.collect()} == wanted
    last = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir)
    assert last.filter("round_trip").count() == kept.count()


def test_pipeline_on_awkward_and_empty_tables(spark, sf_dir, awkward):
    """Nulls, empty, giant and repeated rows, null and repeated ids, clashing columns; and nothing at all."""
    import corpus_pipeline

    twice = awkward.unionByName(awkward.filter("doc_id > 7")).unionByName(awkward.filter("doc_id = 9").withColumn("doc_id", F.lit(None).cast("long")))
    for docs in (twice, empty(awkward)):
        kept = docs
        for name, stage in corpus_pipeline.STAGES[1:-1]:
            before, kept = kept, corpus_pipeline.materialize(stage(spark, kept, sf_dir), name)
            assert kept.columns == docs.columns
            if name == "exact_dedup":
                assert sorted(brute.SPACE.sub("", r.text or "") for r in kept.collect()) == sorted({brute.SPACE.sub("", r.text or "") for r in before.collect()})
            if name == "mixing":
                assert kept.count() <= 3 * before.count() and (kept.count() > 0) == (before.count() > 0)
        last = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir)
        assert last.filter("round_trip").count() == kept.count()
        assert corpus_pipeline.STAGES[0][1](spark, docs, sf_dir).columns == docs.columns


def test_quality_scores_equal_a_plain_evaluation(spark, sf_dir):
    """The compiled column against the rules one by one, over a whole table."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.with_statistics(docs.select("doc_id", "text"), ["doc_id"]).persist()
    model = quality.train(found, labels)
    assert model.rules
    scores = {r.doc_id: r.score for r in QUERIES["op4_quality_rules"](spark, sf_dir).collect()}
    for r in docs.collect():
        x = np.array(quality.statistics_of((r.text or "").encode()))
        margin = model.intercept
        for path, weight in model.rules:
            margin += weight * all(x[f] <= t if left else x[f] > t for f, t, left in path)
        assert scores[r.doc_id] == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-9)


def plain_url(url):
    """host, path and rule of a URL, by the contract."""
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    after = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = brute.lower(host)
    fits = [(len(r), r) for _, r in urls.RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and after.startswith("/" + p)]
    return host, after, max(fits)[1] if fits else None


def test_url_query_equals_a_plain_version(spark, sf_dir):
    """Host, path, rule and verdict over all pages; of those without a rule, by the trees one by one."""
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = by_id(QUERIES["op9_url_filter"](spark, sf_dir))
    verdicts = {r: v for v, r in urls.RULES}
    assert rows.keys() == pages.keys()
    for i, url in pages.items():
        host, path, rule = plain_url(url)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule)
        assert rows[i].verdict == (verdicts[rule] if rule else "block" if rows[i].score > 0.5 else "allow")


def test_large_buckets_stay_linear(spark, monkeypatch):
    """Members that are all apart, but for one band, don't meet in every block; a pair that agrees on two bands does."""
    monkeypatch.setattr(near_dedup, "BLOCK", 64)
    rng = np.random.default_rng(8)
    n = 4096
    registers = rng.integers(0, 60_000, (n, near_dedup.REGISTERS)).astype(np.uint16)
    registers[:, : near_dedup.ROWS] = 7
    registers[1] = registers[0]
    rows = [(1, 0, n, n - 1, 0, i, i, 100, bytearray(registers[i].tobytes())) for i in range(n)]
    members = spark.createDataFrame(rows, "bucket long, band int, size long, guests long, main long, id long, component long, n_shingles long, registers binary")
    seats = near_dedup.seated(near_dedup.split_hot(members))
    assert seats.count() < 400 and near_dedup.seated(members).count() > 64 * n
    few = near_dedup.seated(near_dedup.split_hot(members.withColumn("guests", F.lit(9).cast("long")).withColumn("component", F.when(F.col("id") < n - 9, F.lit(0)).otherwise(F.col("id")))))
    assert few.count() < 3 * n
    agree = np.zeros((1, near_dedup.REGISTERS), bool)
    agree[0, [0, 1, 2, 3, 8, 9, 10, 11]] = True
    bands = near_dedup.BANDS
    assert near_dedup.met_first(agree.copy(), 0)[0] and not near_dedup.met_first(agree.copy(), 2)[0] and near_dedup.met_first(agree.copy(), bands + 2)[0] and not near_dedup.met_first(agree.copy(), 3 * bands)[0]


def test_links_are_the_same_in_buckets_of_any_size(spark, monkeypatch):
    """Texts that share a passage, some with a near copy that agrees on a band or two: split buckets leave no link out."""
    rng = np.random.default_rng(4)
    passage, rows = [f"p{i}" for i in range(60)], []
    for i in range(150):
        own = [f"o{i}x{k}" for k in range(40)]
        rows.append((2 * i, " ".join(passage + own)))
        if i % 3 == 0:
            words = passage + own
            for k in rng.choice(100, 24, replace=False).tolist():
                words[k] = f"n{i}x{k}"
            rows.append((2 * i + 1, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = lambda: {r.doc_id: r.component_id for r in near_dedup.near_groups(docs, 1, 60).collect()}
    whole = groups()
    assert 20 < sum(i != c for i, c in whole.items()) <= 50
    monkeypatch.setattr(near_dedup, "BLOCK", 1)
    assert groups() == whole


def test_many_maps_give_the_same_groups(spark):
    rows = [(i, f"text {i % 700}") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = (by_id(exact_dedup.exact_groups(docs, max_bits=b)) for b in (1 << 22, 1 << 12))
    assert exact_dedup.parts_of(1000, 1 << 12) == 4 and one == many and sum(not r.kept for r in one.values()) == 300


def test_batch_bounds_are_read_in_any_unit(spark):
    from quarry.llm.common import small_batches

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    for given, wanted in (("64m", f"{4 << 20}b"), ("1m", "1m"), (f"{9 << 20}b", f"{4 << 20}b")):
        spark.conf.set(key, given)
        small_batches(spark)
        assert spark.conf.get(key) == wanted
    spark.conf.set(key, before)


def test_long_conversations_are_linear(spark):
    rows = [(1, i, "assistant" if i == 5999 else "user", f"t{i}") for i in range(6000)]
    made = chat.prefix_targets(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("head", F.lit("clash")))
    found = chat.read_back(made).first()
    assert (found.n_turns, found.n_examples, found.loss_chars) == (6000, 1, 5)


def test_word_hashes_are_of_words_alone(texts):
    """Whatever stands around a word, and wherever a text is cut: long words, long texts, other white space, other scripts."""
    from quarry.llm import words

    cases = [t.encode() for t in texts[0].values()] + [t.encode() for t in TEXTS if t] + [b"", b" \n", b"A\x0bb", b"a" * 5000 + b" b", b"x" * 3_000_000, b" ".join([b"y" * 2_500_000, b"z", b"y" * 2_500_000]), b"w " * 700_000]
    plain = [t.lower().split() for t in cases]
    found, offsets = words.hashed_words(cases)
    assert np.diff(offsets).tolist() == [len(p) for p in plain]
    seen = {}
    for word, h in zip((w for p in plain for w in p), found.tolist(), strict=True):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)
    assert words.hashed_words([])[1].tolist() == [0] and lm_scoring.tokens([b"", b"a b"])[1].tolist() == [0, 1, 4]


def test_null_and_repeated_ids_are_each_reported(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, "mail a@b.cd"), (None, "mail a@b.cd"), (None, None), (1, "call +1 (743) 555-3824"), (1, "call +1 (743) 555-3824"), (1, long), (2, long + " end"), (3, "other words"), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash"))
    ids = sorted((i is None, i or 0) for i, _ in rows)
    held = lambda out: sorted((r.doc_id is None, r.doc_id or 0) for r in out)
    found = pii.find(docs).collect()
    assert held(found) == ids and sorted(r.n_email for r in found) == [0] * 7 + [1] * 2 and sum(r.n_phone for r in found) == 2
    marks = spark.createDataFrame([(1, 1), (3, 0), (None, 1)], "doc_id long, quality int")
    scored = quality.classify(docs, marks).collect()
    assert held(scored) == ids and all(0 <= r.score <= 1 for r in scored)
    spoken = lm_scoring.score_documents(docs).collect()
    assert held(spoken) == ids and sorted(r.n_tokens for r in spoken) == sorted(len((t or "").split()) + 1 for _, t in rows)
    near = near_dedup.near_groups(docs, 3, 85).collect()
    # The texts of one doc_id are one document, so 1 and 2 are linked by the long ones.
    assert held(near) == ids and {r.component_id for r in near if r.doc_id in (1, 2)} == {1} and {r.component_id for r in near if r.doc_id == 3} == {3} and {r.component_id for r in near if r.doc_id is None} == {None}
    exact = exact_dedup.exact_groups(docs).collect()
    assert held(exact) == ids and sorted(r.group_size for r in exact) == [1, 1, 1, 2, 2, 2, 2, 2, 2]
