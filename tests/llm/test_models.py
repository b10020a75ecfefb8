"""The trained models, on held-out rows, and benchmark decontamination against brute force."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import decontam, langid, toxicity
from tallyloom.llm.sampling import bounded_sample, held_out

SYLLABLES = {"aa": "ka ko ku ta to tu", "bb": "lirr lerr lorr mirr merr morr", "cc": "shé shà çu çi ñe ñi"}


@pytest.fixture(scope="module")
def languages(corpus, prose):
    rows = [(i, " ".join(prose(i, 20 + i % 60, SYLLABLES[lang].split())), lang) for i, lang in enumerate(random.Random(1).choices(list(SYLLABLES), k=300))]
    return corpus(rows)


def test_folds(spark):
    got = {r["id"]: r["h"] for r in spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(50)}
    rows = spark.range(5000).withColumnRenamed("id", "doc_id").withColumn("kind", F.when(F.col("doc_id") % 1000 == 0, "rare").otherwise("usual")).withColumn("place", F.lit(1))
    rows = rows.unionByName(rows.filter("doc_id = 1").crossJoin(spark.range(3000).select()))
    got = bounded_sample(rows, "kind", 200, "x")
    assert got.columns == rows.columns and {r["kind"]: r["count"] for r in got.groupBy("kind").count().collect()} == {"rare": 5, "usual": 200}
    assert got.exceptAll(bounded_sample(rows.repartition(7), "kind", 200, "x")).count() == 0 and bounded_sample(rows, "kind", 9000, "x").count() == rows.count()


def test_language_of_held_out_documents(languages):
    model = langid.fit(languages)
    out = langid.predicted(languages.select("doc_id", "text"), model).join(languages.select("doc_id", "lang"), "doc_id").filter(held_out(F.col("doc_id"))).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in out]) > 0.95 and all(0 <= r["score"] <= 1 for r in out)


def test_language_of_odd_texts(spark, corpus, languages, prose):
    model = langid.fit(languages)
    odd = corpus([(1, None), (2, ""), (3, "123 !?"), (3, "½ ² ① Ⅷ"), (4, "k"), (5, " ".join(prose(1, 40_000, SYLLABLES["aa"].split()))), (5, "x"), (None, "lirr")]).withColumn("score", F.lit("clash"))
    out = langid.predicted(odd, model)
    got = {(r["doc_id"], len(r["text"] or "")): r["lang_pred"] for r in out.collect()}
    assert got[1, 0] == got[2, 0] == got[3, 6] == got[3, 7] == "und" and got[4, 1] in SYLLABLES and len(got) == 8
    assert next(v for (i, n), v in got.items() if i == 5 and n > 1) == "aa"
    assert {r["lang_pred"] for r in langid.predicted(odd, langid.fit(odd.limit(0))).collect()} == {"und"}
    assert langid.predicted(odd.limit(0), model).count() == 0


def test_every_position_counts_once_in_the_pool():
    model = langid.train([b"ka ko ku " * 9, b"lirr merr " * 9], ["a", "b"], epochs=1)
    text = b"ka ko lirr " * 20
    rows = [text[i : i + langid.STEPS] for i in range(0, len(text), langid.STEPS)]
    want = sum(model.labels(np.frombuffer(r.ljust(langid.STEPS, b"\0"), np.uint8)[:, None])[: len(r), 0].sum(0) for r in rows) / len(text)
    both = model.pooled([b"x", text])
    assert np.allclose(both[1], want, atol=1e-5) and np.allclose(both.sum(1), 1, atol=1e-5)


def test_recurrent_gradients_are_those_of_finite_differences():
    rng = np.random.default_rng(2)
    draw = lambda *s: rng.normal(0, 0.2, s)
    n = langid.STATE
    d = langid.Direction(draw(256, 2 * n) + 0.5, draw(n, 2 * n), draw(256, n), draw(n, n))
    steps, up = rng.integers(0, 9, (7, 5)).astype(np.uint8), rng.normal(size=(7, 5, n))
    kept = []
    states = d.states(steps, kept)
    grads = d.backward(steps, states, kept, up)
    for value, grad in zip((d.gates, d.gates_back, d.new, d.new_back), grads, strict=True):
        at = (int(steps[3, 2]), 3) if len(value) == 256 else (2, 1)
        old = value[at]
        value[at] = old + 1e-2
        high = (d.states(steps) * up).sum()
        value[at] = old - 1e-2
        low = (d.states(steps) * up).sum()
        value[at] = old
        assert abs((high - low) / 2e-2 - grad[at]) < 0.05 * max(1, abs(grad[at]))


@pytest.fixture(scope="module")
def toxic(corpus, prose, spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        bad, lang = rng.random() < 0.3, rng.choice(["aa", "bb"])
        w = prose(i, 30 + i % 200, SYLLABLES[lang].split())
        if bad:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["zornig", "grobian", "schuft"]) + rng.choice(["", "en", "er", "st"]))
        rows.append((i, " ".join(w), lang))
        if i % 10:
            labels.append((i, 1, int(bad)))
    return corpus(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_of_held_out_documents(toxic):
    docs, labels = toxic
    model = toxicity.fit(docs, labels)
    out = toxicity.scored(docs.select("doc_id", "text"), model).join(labels, "doc_id").filter(held_out(F.col("doc_id"))).collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in out]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= toxicity.LIMIT) for r in out)


def test_toxicity_of_odd_texts(toxic, corpus, prose):
    docs, labels = toxic
    model = toxicity.fit(docs, labels)
    odd = corpus([(1, None), (2, ""), (3, " ".join(prose(1, 150_000)) + " zornigen grobian schuft"), (4, "zornigen grobian schuft"), (4, "zornigen grobian schuft"), (None, "x")]).withColumn("score", F.lit("clash"))
    got = sorted((r["doc_id"] or 0, r["predicted"]) for r in toxicity.scored(odd, model).collect())
    assert got == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (4, 1)]
    assert toxicity.fit(docs, labels.limit(0)) is None
    assert {r["score"] for r in toxicity.scored(odd, None).collect()} == {0.0} and toxicity.scored(odd.limit(0), model).count() == 0


def test_toxicity_learns_from_bounded_rows(toxic, corpus, spark, monkeypatch):
    docs, labels = toxic
    one = docs.join(labels, "doc_id").filter(~held_out(F.col("doc_id"))).first()
    again = docs.filter(F.col("doc_id") == one["doc_id"]).crossJoin(spark.range(3000).select())
    seen, train = [], toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda texts, *more: seen.append([len(t) for t in texts]) or train(texts, *more, epochs=1))
    monkeypatch.setattr(toxicity, "TRAIN_CHARS", 50)
    toxicity.fit(docs.unionByName(again), labels, rows=40)
    assert len(seen[0]) <= 80 and max(seen[0]) <= 25


def test_toxicity_learns_from_every_row(corpus, prose, spark, monkeypatch):
    """Of 3,600 toxic rows, those that a sample of 3,000 leaves out are the only ones with a word; more than one shard."""
    ids = [i for i in range(6000) if zlib.crc32(str(i).encode()) % 4 != 2][:4400]
    labels = spark.createDataFrame([(i, 1, int(n < 3600)) for n, i in enumerate(ids)], "doc_id long, quality int, toxic int")
    taken = {r["doc_id"] for r in bounded_sample(labels.select("doc_id", F.col("toxic").alias("y")), "y", 3000, "toxicity").collect()}
    rows = [(i, " ".join([*prose(i, 8), ("zornig" if i in taken else "schuft") if n < 3600 else "freundlich"])) for n, i in enumerate(ids)]
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 1500)
    probes = corpus([(i, " ".join([*prose(10_000 + i, 8), word])) for i in range(20) for word in ("schuft", "freundlich")])
    models = [toxicity.fit(corpus(rows, parts), labels) for parts in (2, 5)]
    got = [[tuple(r) for r in toxicity.scored(probes, m).orderBy("doc_id", "text").select("text", "score", "predicted").collect()] for m in models]
    assert got[0] == got[1]  # whatever the partitions
    assert sum(p == ("schuft" in text) for text, _, p in got[0]) >= 38


def test_toxicity_learns_from_whole_texts(corpus, spark, monkeypatch):
    """The telling words stand after 60,000 characters; a row that repeats an id is learnt as well."""
    rows = [(i, "wort " * 12_100 + ("schuft" if i % 2 else "freundlich")) for i in range(80)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(80)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(toxicity, "PART", 5000)
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    model = toxicity.fit(corpus([*rows, (1, "grobian")]), labels)
    odds = {w: model.embedding[toxicity.word_ids(w)[0, 0], 0] for w in ("schuft", "grobian", "freundlich")}
    assert odds["schuft"] > 1 and odds["grobian"] > 0.2 and odds["freundlich"] < -1


def test_toxicity_gradients_are_those_of_finite_differences():
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 50, (n, 2)).astype(np.int32) for n in (1, 4, 9, 30)]
    y = np.array([1, 0, 1, 0])
    m = toxicity._initial(docs, y, [None] * 4, rng)
    m.embedding = rng.normal(0, 1, m.embedding.shape)
    m.embedding[toxicity.BUCKETS] = 0
    m.weights, m.output = [rng.normal(0, 0.5, w.shape) for w in m.weights], rng.normal(0, 0.5, m.output.shape)
    start = {"e": m.embedding.copy(), "o": m.output.copy()} | {("w", k): w.copy() for k, w in enumerate(m.weights)}

    def loss():
        p = m.raw(*toxicity._laid_out(docs))
        return -np.log(np.where(y == 1, p, 1 - p)).mean()

    toxicity._epoch(m, docs, y, 1.0, np.random.default_rng(1), state := {})  # a step is rate * g / sqrt(0.1 + g * g)
    moved = {"e": m.embedding, "o": m.output} | {("w", k): w for k, w in enumerate(m.weights)}
    grads = {name: (start[name] - moved[name]) * np.sqrt(state[name]) for name in start}
    for name in start:
        moved[name][...] = start[name]
    m.base = -1.0
    for b in m.biases:
        b[...] = 0
    for name, grad in grads.items():
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        moved[name][at] += 1e-4
        high = loss()
        moved[name][at] -= 2e-4
        low = loss()
        moved[name][at] += 1e-4
        assert abs((high - low) / 2e-4 - grad[at]) < 0.02 * abs(grad[at]) + 1e-4, name


def test_thresholds_follow_the_language():
    rng = np.random.default_rng(9)
    docs, y, names = [], [], []
    for k in range(400):
        lang, bad = k % 2, k % 5 == 0
        w = rng.integers(100 + 1000 * lang, 200 + 1000 * lang, 20)
        w[0] = 5000 + lang if bad and (lang == 0 or k % 3) else w[0]
        docs.append(np.stack([w, w], 1).astype(np.int32))
        y.append(int(bad))
        names.append("ab"[lang])
    m = toxicity.train(docs, np.array(y), names, epochs=2)
    assert len(m.thresholds) == 2 and (m.language(*toxicity._laid_out(docs)) == np.arange(400) % 2).all()
    p, t = m.raw(*toxicity._laid_out(docs)), m.thresholds[np.arange(400) % 2]
    assert ((m.score(docs) >= toxicity.LIMIT) == (p >= t)).mean() > 0.99


def brute(docs, items):
    found = set()
    for i, text in docs:
        w = decontam.words(text)
        for k, t in items:
            if t and decontam.words(t):
                parts = decontam.question_and_answer(t)
                if all(len(s & decontam.shingles(w, min(5, len(p)))) >= 0.8 * len(s) for p in parts for s in [decontam.shingles(p, min(5, len(p)))]):
                    found.add((i, k))
    return found


@pytest.mark.parametrize("limits", [(500_000, 8), (200, 1), (200, 1000)])
def test_leaks_are_those_of_brute_force(spark, corpus, prose, monkeypatch, limits):
    monkeypatch.setattr(decontam, "INDEX_WORDS", limits[0])
    monkeypatch.setattr(decontam, "BLOCK", limits[1])
    items = []
    for k in range(25):
        w = prose(1000 + k, 15 + k)
        items.append((k, " ".join(w[:10]).capitalize() + ". " + " ".join(w[10:]).capitalize() + "."))
    items += [(50, None), (51, " ... "), (52, " ".join(prose(77, 200))), (53, "one two. three"), (None, "x y z")]
    rng, docs = random.Random(3), []
    for i in range(80):
        w = prose(i, 20 + 17 * (i % 30))
        if i % 3 == 0:
            k, text = items[rng.choice([*range(25), 27])]
            own = text.upper().split()
            if i % 9 == 0:
                own[0] = "other"
            if i % 18 == 0:
                own = own[: len(own) // 2]
            at = rng.randrange(len(w))
            w[at:at] = own
        docs.append((i, " ".join(w)))
    docs += [(100, None), (101, ""), (102, "And one, two; THREE!"), (103, items[3][1]), (104, items[3][1])]
    bench = spark.createDataFrame(items + items[:3], "item_id long, text string")
    own = corpus(docs).withColumn("leaks", F.lit("clash"))
    got = {(r["doc_id"], x["item_id"]) for r in decontam.marked(own, bench).collect() for x in r["leaks"]}
    assert got == brute(docs, items) and len(got) > 15
    assert decontam.marked(own, bench.limit(0)).filter(F.size("leaks") > 0).count() == 0 and decontam.marked(own.limit(0), bench).count() == 0


def exhaustive(index, c, passage):
    """BM25 of a passage (a set of term numbers) with every item, by looking at every posting."""
    n = len(c.items)
    scores = np.zeros(n)
    for t in passage:
        for k in range(c.first[t], c.first[t + 1]):
            scores[c.keys[k] - t * (n + 1)] += c.impacts[k]
    return scores


@pytest.mark.parametrize("block", [1, 3, 8])
def test_block_max_wand_retrieves_what_exhaustive_scoring_does(monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK", block)
    rng = np.random.default_rng(block)
    vocabulary = [f"w{k}" for k in range(400)]
    draw = lambda n: [vocabulary[int(x)] for x in np.minimum(399, rng.zipf(1.3, n) - 1)]
    items = [(k, " ".join(draw(int(rng.integers(4, 60))))) for k in range(300)]
    index = decontam.Index.of(items)
    [c] = index.classes
    rows, want = [], set()
    for p in range(250):
        own = draw(80) + (items[int(rng.integers(300))][1].split()[: int(rng.integers(2, 60))] if p % 2 else [])
        rows.append(sorted({index.terms[w] for w in own if w in index.terms}))
        want |= {(p, int(k)) for k in np.flatnonzero(exhaustive(index, c, rows[-1]) >= decontam.SCORE - 1e-9)}
    width = max(map(len, rows))
    padded = np.array([r + [len(index.terms)] * (width - len(r)) for r in rows])
    got = [(p, k) for p, k, score in c.retrieved(padded)]
    assert set(got) == want and len(got) == len(want) > 60
    assert c.counted["scored"] < 0.7 * 250 * 300 and c.counted["skipped"] > 0


def test_a_long_item_changes_nothing_for_the_others(spark, corpus, prose):
    items = [(k, " ".join(prose(300 + k, 30)) + ". " + " ".join(prose(400 + k, 12)) + ".") for k in range(20)]
    apart = [w for k in range(5) for w in [*items[3][1].split()[k * 8 : k * 8 + 8], *prose(77 + k, 300)]]
    docs = corpus([(k, " ".join(prose(k, 100)) + " " + items[k][1]) for k in range(20)] + [(50, " ".join(apart))])
    found = lambda bench: {(r["doc_id"], x["item_id"], x["question"], x["answer"]) for r in decontam.marked(docs, spark.createDataFrame(bench, "item_id long, text string")).collect() for x in r["leaks"] if x["item_id"] != 99}
    alone = found(items)
    assert {(d, i) for d, i, *_ in alone} >= {(k, k) for k in range(20)} and not [x for x in alone if x[0] == 50]
    assert found([*items, (99, " ".join(prose(999, 5000)))]) == alone
