"""Near-duplicate classes and repeated passages against brute force, and the pipeline."""

import itertools
import random
import re
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import neardup, suffixdedup


def changed(rng, w, share):
    return [x if rng.random() > share else f"q{rng.randrange(10**6)}" for x in w]


@pytest.fixture(scope="module")
def copies(prose):
    rng, docs = random.Random(8), []
    for base in range(12):
        w = prose(base, 150 + 20 * base)
        docs.append(" ".join(w))
        docs += [" ".join(changed(rng, w, s)) for s in (0.0, 0.01, 0.02, 0.03, 0.05, 0.2)]
        docs.append(" ".join(w).upper() + "!")
    docs += [" ".join(changed(rng, prose(99, 200), 0.02)) for _ in range(40)]
    docs += ["a b", "a b", "A, b.", "c", None, "", " ... ", " ".join(["x y z"] * 200), " ".join(["x y z"] * 190)]
    rng.shuffle(docs)
    return list(enumerate(docs))


def brute_classes(docs):
    up = {i: i for i, _ in docs}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for (i, a), (j, b) in itertools.combinations(docs, 2):
        if neardup.similarity(a, b) >= 0.8:
            x, y = sorted((top(i), top(j)))
            up[y] = x
    return {i: top(i) for i, _ in docs}


@pytest.mark.parametrize("limits", [(512, 16), (4, 2)])
def test_classes_are_those_of_brute_force(corpus, copies, monkeypatch, limits):
    monkeypatch.setattr(neardup, "BLOCK", limits[0])
    monkeypatch.setattr(neardup, "COMMON", limits[1])
    got = neardup.classes(corpus(copies).withColumn("family", F.lit("clash")).withColumn("bands", F.lit(1)))
    rows = got.collect()
    assert len(rows) == len(copies) and {r["doc_id"]: r["class_id"] for r in rows} == brute_classes(copies)


def test_classes_of_odd_tables(corpus):
    assert neardup.classes(corpus([])).count() == 0
    rows = neardup.classes(corpus([(None, "a b c"), (5, "a b c"), (5, "a b c"), (3, "A B C"), (9, None)])).collect()
    assert sorted((r["doc_id"] or 0, r["class_id"]) for r in rows) == [(0, None), (3, 3), (5, 3), (5, 3), (9, 9)]


def test_rows_of_one_id_are_members_by_their_own_texts(corpus, prose):
    rng = random.Random(4)
    a, b = prose(1, 120), prose(2, 120)
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, " ".join(changed(rng, b, 0.01))), (9, " ".join(changed(rng, a, 0.01))), (3, "alone")]
    got = sorted((r["doc_id"], r["class_id"]) for r in neardup.classes(corpus(rows)).collect())
    assert got == [(3, 3), (5, 5), (5, 5), (7, 5), (9, 5)]


def test_a_family_mostly_under_the_limit_loses_no_link(spark, corpus, prose, monkeypatch):
    """Texts that share 80 % of their words: one family, hardly a link; what travels is counted."""
    monkeypatch.setattr(neardup, "BLOCK", 32)
    monkeypatch.setattr(neardup, "COMMON", 4)
    sent, linked = [], neardup._linked
    monkeypatch.setattr(neardup, "_linked", lambda cells: sent.append(cells.count()) or linked(cells))
    base, n = prose(5, 200), 300
    docs = [(k, " ".join(base[:160] + prose(1000 + k, 40))) for k in range(n)]
    docs += [(n + k, docs[k * 7][1] + " z") for k in range(20)]
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(corpus(docs)).collect()}
    assert all(got[n + k] == got[k * 7] for k in range(20)) and got == brute_classes(docs)
    assert sum(sent) < (n + 20) * (2 + 2 * (n + 20) / 32)


def test_signatures_estimate_weighted_jaccard_without_bias():
    estimates, truth = [], None
    for k in range(150):
        a = [f"a{k}"] * 120 + [f"b{k} {i}" for i in range(40)]
        b = [f"a{k}"] * 60 + [f"b{k} {i}" for i in range(50)]
        estimates.append((neardup.signature(*neardup.bag(neardup.words(" ".join(a)))) == neardup.signature(*neardup.bag(neardup.words(" ".join(b))))).mean())
        truth = neardup.similarity(" ".join(a), " ".join(b))
    assert abs(np.mean(estimates) - truth) < 0.02


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    up = list(range(1100))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    got = {r["node"]: r["component"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: top(i) for i in range(1100) if top(i) != i}


def brute_removal(docs):
    first, out = {}, {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        w = re.findall("[^\x20\x09-\x0d]+", text or "")
        gone = [False] * len(w)
        for s in range(len(w) - 49):
            if first.setdefault(tuple(w[s : s + 50]), i) < i:
                gone[s : s + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), sha256(kept.encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def passages(prose):
    rng, docs = random.Random(6), []
    shared = [prose(500 + k, n) for k, n in enumerate((49, 50, 51, 80, 300))]
    for i in range(90):
        w = prose(i, rng.randrange(0, 260))
        for _ in range(rng.randrange(0, 3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(shared)[rng.randrange(0, 3) :]
        docs.append("\n".join(w))
    docs += [docs[3], docs[7] + " tail", docs[3], None, "", "a " * 49, "a " * 50, "a " * 120, "a " * 120 + "b", "ab " * 70, ("ab cd " * 60).strip(), " ".join(shared[4]), "x\x85y z " * 60, "x\x85y z " * 55]
    return list(zip(rng.sample(range(1000), len(docs)), docs, strict=True))


@pytest.mark.parametrize("limits", [(20_000, 400_000), (3, 600), (5, 100)])
def test_removal_is_that_of_brute_force(corpus, passages, monkeypatch, limits):
    monkeypatch.setattr(suffixdedup, "GROUP_ROWS", limits[0])
    monkeypatch.setattr(suffixdedup, "TREE_WORDS", limits[1])
    rows = suffixdedup.deduplicated(corpus(passages).withColumn("n_words", F.lit("clash"))).collect()
    assert len(rows) == len(passages)
    got = {r["doc_id"]: (r["n_words"], sum(s["stop"] - s["start"] for s in r["spans"]), sha256(r["text"].encode()).hexdigest()) for r in rows}
    assert got == brute_removal(passages)


def test_removal_of_odd_tables(corpus, prose):
    assert suffixdedup.deduplicated(corpus([])).count() == 0
    text = " ".join(prose(1, 60))
    rows = suffixdedup.deduplicated(corpus([(None, text), (4, text), (4, text), (2, text)])).collect()
    assert sorted((r["doc_id"] or 0, len(r["text"].split())) for r in rows) == [(0, 60), (2, 60), (4, 0), (4, 0)]


def test_rows_of_one_id_are_judged_by_their_own_texts(corpus, prose):
    a, b = " ".join(prose(1, 70)), " ".join(prose(2, 70))
    rows = suffixdedup.deduplicated(corpus([(1, a), (5, a), (5, b), (5, b + " x"), (8, b)])).collect()
    assert sorted((r["doc_id"], len(r["text"].split())) for r in rows) == [(1, 70), (5, 0), (5, 70), (5, 71), (8, 0)]


def test_a_tree_has_the_nodes_of_plain_comparison():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 2, 400)
    starts = rng.permutation(394)[:300]
    for depth in (7, 6):
        tree = suffixdedup.Tree(w, starts, depth)
        own = [tuple(w[p : p + depth]) for p in starts[tree.leaves]]
        common = [next((k for k in range(depth) if a[k] != b[k]), depth) for a, b in zip(own, own[1:])]
        assert tree.depths.tolist() == common
        for d in range(1, depth + 1):
            begin = tree.nodes(d)
            sizes = np.diff(np.append(begin, len(own)))
            assert len({x[:d] for x in own}) == len(begin) and all(len({x[:d] for x in own[b : b + n]}) == 1 for b, n in zip(begin, sizes))


def test_trees_hold_a_bounded_number_of_words(spark, corpus, prose, monkeypatch):
    """One group with a thousand runs that differ: more than a tree may hold, with and without split groups."""
    line = prose(3, 20)
    docs = [(k, " ".join([*prose(100 + k // 2, 40), *line, *prose(900 + k // 3, 40)])) for k in range(300)]
    monkeypatch.setattr(suffixdedup, "TREE_WORDS", 2000)
    for rows in (50, 10**6):
        monkeypatch.setattr(suffixdedup, "GROUP_ROWS", rows)
        got = {r["doc_id"]: (r["n_words"], sum(s["stop"] - s["start"] for s in r["spans"]), sha256(r["text"].encode()).hexdigest()) for r in suffixdedup.deduplicated(corpus(docs)).collect()}
        assert got == brute_removal(docs)
