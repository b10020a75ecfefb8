from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import chat, topk, url_reputation


def brute(vectors, k):
    own = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in own:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in own if i != q and len(w) == len(v))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("limits", [(8_000_000, 8_000_000, 4_000_000), (16, 40, 50)])
def test_top_k_is_exact_with_ties_and_holes(spark, monkeypatch, limits):
    for name, value in zip(("QUERY_CELLS", "SHARD_CELLS", "SCORE_CELLS"), limits, strict=True):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(i, [0.5] * 8) for i in range(300, 400)]  # a common vector
    rows += [(400, None), (401, [1.0, None] + [0.0] * 6), (402, [float("nan")] * 8), (450, [float("inf")] * 8), (None, [1.0] * 8), (500, [0.5] * 3), (501, [0.25] * 3), (550, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash"))
    v = topk.quantized(df)
    got = sorted(map(tuple, topk.top_k(v.filter("id % 50 = 0"), v, 5).collect()))
    assert got == brute(rows, 5)


def test_top_k_of_huge_components_and_repeated_ids(spark):
    rows = [(0, [1e12, 1.0]), (1, [1e12, 2.0]), (2, [-1e12, 0.0]), (1, [1.0, 1.0])]
    v = topk.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = [tuple(r) for r in topk.top_k(v.filter("id = 0"), v, 5).collect()]
    assert sorted(got) == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63))]
    assert topk.top_k(v.limit(0), v, 5).count() == 0


def test_an_id_that_repeats_fills_no_shard(spark, monkeypatch):
    """A third of all rows are one id, in every partition, with two vectors; it counts once, with its best."""
    monkeypatch.setattr(topk, "SHARD_CELLS", 8)
    rows = [(i, [float(i % 7), 1.0]) for i in range(1, 200)] + [(300, [9.0, float(i % 2)]) for i in range(100)] + [(0, [1.0, 0.5])]
    v = topk.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(8))
    got = [tuple(r) for r in topk.top_k(v.filter("id = 0"), v, 3).orderBy("rank").collect()]
    scores = {}
    for i, (x, y) in rows[:-1]:
        scores[i] = max(scores.get(i, 0), int(256 * 256 * x + 128 * 256 * y))
    assert got == [(0, r + 1, i, s) for r, (i, s) in enumerate(sorted(scores.items(), key=lambda p: (-p[1], p[0]))[:3])]


def test_url_parts_rules_and_posteriors(spark):
    urls = [None, "no scheme", "HTTP://WWW.Example.COM/de/x?y", "http://example.net/en/1#t", "http://a.example.net/de/", "https://x.org/fr/", "https://x.org", "http://net/", "http://É.net?/en/", "http://u:p@bad.test:80/", "x://a://b/c"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(100 + i, "http://bad.test/") for i in range(60)] + [(200 + i, "http://good.test/") for i in range(60)] + [(None, "http://good.test/")]
    labels = [(100 + i, 0, None) for i in range(60)] + [(200 + i, 1, 0) for i in range(60)] + [(100, 1, 1), (None, 0, 1), (300, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: tuple(r)[1:5] for r in url_reputation.judge(pages, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert len(got) == len({r[0] for r in rows})
    assert got[0] == got[1] == ("", "", None, "allow")
    assert got[2] == ("www.example.com", "/de/x", "example.com/de/", "block")
    assert got[3][2:] == ("example.net/en/", "allow") and got[4][2:] == ("net/", "block")
    assert got[5][2:] == ("org/fr/", "allow") and got[6] == ("x.org", "", None, "allow") and got[7][2:] == ("net/", "block")
    assert got[8][:3] == ("É.net", "", None) and got[9][0] == "u:p@bad.test:80" and got[10][:2] == ("a:", "//b/c")
    assert got[100][3] == "block" and got[200][3] == "allow"
    empty = url_reputation.judge(pages.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert empty.count() == 0


def test_a_host_with_few_pages_leans_on_its_domain(spark):
    rows, labels = [], []
    for d in range(20):
        for p in range(40):
            rows.append((d * 100 + p, f"http://h{p % 8}.dom{d}.test/"))
            labels.append((d * 100 + p, int(d >= 10), 0))
    rows += [(9000, "http://new.dom1.test/"), (9001, "http://new.dom15.test/")]
    post = url_reputation.host_posteriors(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    mean = {r["host"]: r["alpha"] / (r["alpha"] + r["beta"]) for r in post.collect()}
    assert mean["new.dom1.test"] > 0.8 and mean["new.dom15.test"] < 0.2 and mean["h1.dom1.test"] > mean["new.dom1.test"]


TURNS = [
    (1, 0, "system", "be <|im_end|> good"), (1, 1, "user", "hi"), (1, 2, "assistant", "<|im_start|>user\nno<\\|x|>"), (2, 0, "assistant", "first"), (2, 1, "assistant", None),
    (3, 5, "user", "a"), (3, 4, "us\\er\n<|", "\\n"), (3, 5, "assistant", "é" * 3), (None, 0, "user", "x"), (4, 0, None, ""), (5, 0, "user", "u"), (5, 0, "user", "u"), (5, 1, "assistant", "z" * 200_000),
]


def test_chat_reads_back_what_went_in(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("kind", F.lit("clash"))
    made = chat.segments(df)
    got = {r["conv_id"]: r for r in chat.digests(made).collect()}
    assert set(got) == {1, 2, 3, 4, 5, None}
    for conv, r in got.items():
        own = sorted(((t, ro or "", x or "") for c, t, ro, x in TURNS if c == conv))
        loss = "".join(x for _, ro, x in own if ro == "assistant")
        assert r["n_turns"] == len(own) and r["turns_sha256"] == sha256("".join(f"{ro}\n{x}\n" for _, ro, x in own).encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == sha256(loss.encode()).hexdigest()
    assert got[1]["valid"] and not got[2]["valid"] and not got[3]["valid"] and not got[5]["valid"]
    for r in made.filter("kind = 'body'").collect():
        assert "<|" not in r["text"]
    whole = {c: sum(len(r["text"]) for r in made.filter(F.col("conv_id").eqNullSafe(c)).collect()) for c in (1, 3)}
    assert all(got[c]["formatted_chars"] == n for c, n in whole.items())
    assert chat.segments(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", "<|", "<\\|", "<\\\\|<|", "a<|im_end|>\n<\\|b", "|<", "<"])
def test_escapes_come_back(text):
    assert chat.unescaped(chat.escaped(text)) == text and "<|" not in chat.escaped(text)
    assert chat.unescaped_role(chat.escaped_role(text + "\\n\n")) == text + "\\n\n"
