"""The pipeline on a small folder of tables, stage by stage against plain Python."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tallyloom.llm import decontam, neardup


@pytest.fixture(scope="module")
def folder(spark, corpus, prose, tmp_path_factory):
    rng = random.Random(12)
    items = [(k, " ".join(prose(900 + k, 20)).capitalize() + ". " + " ".join(prose(950 + k, 12)).capitalize() + ".") for k in range(6)]
    rows, labels, planted = [], [], {"toxic": set(), "copy": set(), "leak": set(), "private": set()}
    for i in range(400):
        w = prose(i, 40 + i % 120)
        if i % 5 == 0:
            planted["toxic"].add(i)
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["zornig", "grobian", "schuft"]))
        elif i % 7 == 0:
            planted["leak"].add(i)
            w += items[i % 6][1].split()
        elif i % 11 == 0:
            planted["private"].add(i)
            w.insert(3, "4111111111111111")
        rows.append((i, " ".join(w)))
        if i % 3:
            labels.append((i, 1, int(i % 5 == 0)))
    for i in range(400, 430):
        planted["copy"].add(i)
        rows.append((i, rows[(i - 399) * 9 + 1][1].upper()))
    rows += [(500, None), (501, ""), (502, "x")]
    path = str(tmp_path_factory.mktemp("tables"))
    corpus(rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, dict(rows), dict(items), planted


def test_stages(spark, folder):
    path, texts, items, planted = folder
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near-duplicates", "decontamination", "pseudonyms", "packing"]
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumns({c: F.lit("own") for c in ("score", "predicted", "leaks", "n_pseudonyms", "finds")})
    kept = [set(texts)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "predicted", "leaks", "n_pseudonyms", "finds"], name
        assert {tuple(r) for r in docs.select("score", "predicted", "leaks", "n_pseudonyms", "finds").distinct().collect()} == {("own",) * 5}
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    clean = set(texts) - planted["toxic"]
    assert len(kept[1] & planted["toxic"]) <= 2 and clean <= kept[1] | {i for i in clean if texts[i] and set(texts[i].lower().split()) & {"zornig", "grobian", "schuft"}}
    left = sorted(kept[1])
    firsts = {i for n, i in enumerate(left) if not any(neardup.similarity(texts[i], texts[j]) >= 0.8 for j in left[:n])}
    assert firsts <= kept[2] and not planted["copy"] & kept[2]
    leaks = {i for i in kept[2] if any(all(len(s & decontam.shingles(decontam.words(texts[i]), 5)) >= 0.8 * len(s) for p in decontam.question_and_answer(t) for s in [decontam.shingles(p, 5)]) for t in items.values())}
    assert kept[3] == kept[2] - leaks and leaks == planted["leak"] & kept[2] and kept[4] == kept[3]
    new = {r["doc_id"]: r for r in docs.collect()}
    for i, r in new.items():
        assert (r["text"] != texts[i]) == (i in planted["private"]) and r["n_chars"] == (None if texts[i] is None else len(r["text"]))


def test_run_packs_what_the_stages_keep(spark, folder):
    path, texts, _, planted = folder
    rows = corpus_pipeline.run(spark, path).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {}
    for r in rows:
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["length"]
    for i, n in sizes.items():
        if i not in planted["private"]:
            assert n == len(tokenizer.encode(texts[i] or "", add_special_tokens=False).ids) + 1
    assert not planted["copy"] & set(sizes) and len(set(sizes) & planted["toxic"]) <= 2
    assert np.all([r["offset"] + r["length"] <= 4096 for r in rows])


def test_near_duplicates_go_by_row(spark, corpus, prose):
    a, b, c, d = (" ".join(prose(70 + k, 60)) for k in range(4))
    rows = [(1, a), (1, a), (1, a), (5, a.upper()), (5, b), (None, c), (None, c), (None, d), (7, d + "!"), (8, "***"), (9, "***"), (None, "***"), (10, "---"), (11, None), (12, None)]
    got = sorted(map(tuple, corpus_pipeline.drop_near_duplicates(spark, corpus(rows), "").select("doc_id", "text").collect()), key=str)
    assert got == sorted([(1, a), (5, b), (None, c), (7, d + "!"), (8, "***"), (10, "---"), (11, None), (12, None)], key=str)
