from unicodedata import normalize
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 2]


def check(rows, docs, size):
    for doc_id, text in docs.items():
        whole = np.asarray(ids(text), "<u4")
        own = sorted((r for r in rows if r["doc_id"] == doc_id), key=lambda r: r["start"])
        at = 0
        for r in own:
            assert r["start"] == at and r["doc_tokens"] == len(whole)
            assert r["ids_crc32"] == crc32(whole[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(whole)
    padding = 0
    for s in {r["sequence_id"] for r in rows}:
        own = sorted((r for r in rows if r["sequence_id"] == s), key=lambda r: r["offset"])
        ends = np.cumsum([r["length"] for r in own])
        assert [r["offset"] for r in own] == [0, *ends[:-1]] and ends[-1] <= size
        padding += 0 if ends[-1] & (ends[-1] - 1) == 0 else size - ends[-1]
    return padding


@pytest.mark.parametrize("size", [16, 256])
def test_every_id_in_one_piece_without_padding(corpus, prose, size):
    docs = {i: " ".join(prose(i, (i * 37) % 400)) for i in range(60)} | {100: None, 101: "", 102: "<|endoftext|> can't   \n\n x_y İ ΑΣ ###!!", 103: " ".join(prose(5, 3000))}
    rows = packing.digested(packing.pack(corpus(list(docs.items())), PATH, size)).collect()
    assert check(rows, docs, size) == 0


def test_words_are_encoded_as_in_the_whole_text():
    tokenizer = Tokenizer.from_file(PATH)
    encode = packing._encoder(PATH)
    for text in ["Don't!!! THE the, The. naïve naïve", "12a3 \x1cx\ty  z　q", "<|startoftext|>a <|endoftext|>", "İstanbul 'sfoo foo's _x_ ...", "日本語 한국어 मानक हि"]:
        for _ in range(2):
            assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_one_encoder_stays_right_in_any_order():
    """Every letter that has a decomposition or another lower case, alone and with punctuation, over one long-lived encoder."""
    tokenizer, rng = Tokenizer.from_file(PATH), np.random.default_rng(5)
    letters = [c for c in map(chr, [*range(0x80, 0x3400), *range(0xA000, 0xABFF), *range(0xF900, 0xFFE0)]) if c.isalpha() and (normalize("NFKD", c) != c or c.lower() != c)]
    words = [w for c in letters for w in (c, f"ka{c}", f"{c}ka", f"{c}.", f"BELGES{c}", f"BELGES{c}.", f"ka{c}ka!?")]
    words += "BELGESİ BELGESİ. belgesi क़ क़. फ़ा फ़ा, ড় ড়! ਸ਼ ਸ਼?".split(" ")
    rng.shuffle(words)
    encode = packing._Words(PATH).encode
    for k in range(0, len(words), 11):
        text = " ".join(words[k : k + 11])
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_open_windows_hold_their_own_ids_only():
    levels, held = packing.Levels(4096), 0
    ids = b"\1\0\0\0" * 10_000_000
    for k in range(20):
        levels.place((k, 9_999_000, 1000 - k, ids[4 * 9_999_000 : 4 * (9_999_000 + 1000 - k)], 10_000_000), 1000 - k)
    held = sum(len(p[3]) for windows in levels.open.values() for w in windows for p in w)
    assert held <= 4 * 20 * 1000
    for window in levels.rest():
        assert all(len(p[3]) == 4 * p[2] for p in window)


def test_sum_of_squares_places_where_the_sum_grows_least():
    rng = np.random.default_rng(3)
    levels = packing.Levels(20)
    for k in range(400):
        length = int(rng.integers(1, 20))
        before = levels.count.copy()
        levels.place((k, 0, length, b"", length), length)

        def after(h, n=before, length=length):
            out = n.copy()
            if h:
                out[h] -= 1
            if h + length < 20:
                out[h + length] += 1
            return int((out[1:20] ** 2).sum())

        options = [after(h) for h in range(21 - length) if h == 0 or before[h]]
        assert int((levels.count[1:20] ** 2).sum()) == min(options)


def test_odd_tables(spark, corpus):
    assert packing.pack(corpus([]), PATH).count() == 0
    twice = corpus([(1, "ba be"), (1, "ba be"), (None, "x")]).withColumn("ids", F.lit("clash")).withColumn("length", F.lit(0))
    rows = packing.pack(twice, PATH, 64).collect()
    assert sum(r["length"] for r in rows) == 2 * len(ids("ba be")) + len(ids("x")) and all(len(r["ids"]) == 4 * r["length"] for r in rows)


def test_parts_of_words_outlive_the_words(monkeypatch):
    """A worker whose memory of words is full reads parts that it has encoded before without the tokenizer."""
    text = "Zwölf Boxkämpfer, jagen: (quer) Überall! 東京 ½x ein.. façade ﬁx"
    words = packing._Words(PATH)
    whole = words.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(words.encode(text), "<u4").tolist() == whole
    monkeypatch.setattr(packing, "WORD_MEMORY", len(words.parts) + 1)
    words.known |= {f"filler{i}": b"" for i in range(99)}
    rows, encoded = set(words.parts), []
    tokenizer, words.tokenizer = words.tokenizer, None

    class Spy:
        def encode_batch_fast(self, texts, **more):
            encoded.extend(texts)
            return tokenizer.encode_batch_fast(texts, **more)

    words.tokenizer = Spy()
    assert np.frombuffer(words.encode(text + " neu"), "<u4").tolist() == tokenizer.encode(text + " neu", add_special_tokens=False).ids
    assert "filler1" not in words.known and not rows.intersection(" ".join(encoded).split(" "))
