"""Benchmark decontamination: a BM25 inverted index of test items, searched by block-max WAND with every passage of the corpus."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, materialize

#: Words of the items of one index, which is broadcast (further items go to further indexes, each searched by all
#: passages), and postings of a block.
INDEX_WORDS, BLOCK = 500_000, 8
#: Words of half a passage for items of up to as many words; longer items have halves of 2, 4, 8 ... times as many.
HALF = 64
#: Share of an item's own BM25 score that a passage must reach; share of shingles of question and of answer; their words.
SCORE, OVERLAP, SHINGLE = 0.6, 0.8, 5
K1, B = 1.2, 0.75
#: Passages that are searched side by side.
ABREAST = 1024
#: A list's maximum in a cursor: its low 32 bits, in these parts, rounded up.
UNIT, LOW = 1 << 24, (1 << 32) - 1
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingles(w: list, n: int) -> set[tuple]:
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The last sentence, or line, is the answer; a text of one is both."""
    parts = [p for p in map(words, _SENTENCE.split(text)) if p]
    return (sum(parts[:-1], []), parts[-1]) if len(parts) > 1 else (parts[0], parts[0])


def half_of(n: int) -> int:
    """Words of half a passage for an item of n words: a matter of the item alone."""
    return HALF << max(0, (n - 1) // HALF).bit_length()


@dataclass
class Postings:
    """The inverted lists of the items of one length class. A list's postings are ordered by item and cut into blocks of
    BLOCK with their greatest impact. Keys are term * (items + 1) + item, so lists lie one after another in one order and
    any place in any list is found by bisection. Impacts are BM25 weights divided by the item's own score, so that one
    threshold serves all items. Term number `terms` is no term; its list is empty."""

    half: int
    items: list[tuple[int, list[int], list[int]]]  # id, question, answer, as term numbers
    keys: np.ndarray
    impacts: np.ndarray
    first: np.ndarray  # the list of term t: first[t] .. first[t + 1]
    top: np.ndarray  # greatest impact of a list
    last: np.ndarray  # item of a list's last posting
    head: np.ndarray  # cursor before a list
    entry: np.ndarray  # cursor at a posting, and one after all
    block_keys: np.ndarray  # of the last posting of a block
    block_item: np.ndarray
    block_first: np.ndarray
    block_top: np.ndarray
    counted: dict = field(default_factory=lambda: {"scored": 0, "skipped": 0, "passages": 0})

    @classmethod
    def of(cls, rows: list[tuple[int, str]], half: int, terms: dict[str, int], idf: np.ndarray, mean: float) -> Postings:
        n, posted, items = len(rows), [], []
        for k, (item_id, text) in enumerate(rows):
            own = [terms[w] for w in words(text)]
            t, many = np.unique(own, return_counts=True)
            weight = idf[t] * many * (K1 + 1) / (many + K1 * (1 - B + B * len(own) / mean))
            posted.append((t * (n + 1) + k, weight / weight.sum()))
            items.append((item_id, *([terms[w] for w in part] for part in question_and_answer(text))))
        keys, impacts = (np.concatenate(x) for x in zip(*posted, strict=True))
        order = np.argsort(keys)
        narrow = (len(terms) + 2) * (n + 1) < 2**31
        keys, impacts = keys[order].astype(np.int32 if narrow else np.int64), impacts[order]
        first = np.searchsorted(keys, np.arange(len(terms) + 2) * (n + 1))
        sizes = -(-np.diff(first) // BLOCK)
        block_first = np.concatenate([[0], np.cumsum(sizes)])
        begin = np.repeat(first[:-1], sizes) + BLOCK * (np.arange(sizes.sum()) - np.repeat(block_first[:-1], sizes))
        last = np.minimum(begin + BLOCK, np.repeat(first[1:], sizes)) - 1
        block_top = np.maximum.reduceat(impacts, begin)
        top = np.zeros(len(terms) + 1)
        top[sizes > 0] = np.maximum.reduceat(block_top, block_first[:-1][sizes > 0])
        term, item = np.divmod(keys.astype(np.int64), n + 1)
        upper = np.ceil(top * UNIT).astype(np.int64)
        entry = np.append((item << 32) | upper[term], n << 32)
        some = first[1:] > first[:-1]
        head = np.where(some, entry[np.minimum(first[:-1], len(keys))], n << 32)
        ends = np.where(some, item[np.maximum(first[1:], 1) - 1], -1)
        return cls(half, items, keys, impacts, first, top, ends, head, entry, keys[last], item[last], np.append(block_first, block_first[-1]), block_top)

    def retrieved(self, terms: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(passage, item, score) of all items that score SCORE or more, for passages given as rows of different term
        numbers, padded with the empty term.

        Block-max WAND, in step for all rows: cursors in order of their items, the pivot is the first item at which the lists'
        maxima could reach the threshold; if the maxima of the blocks that hold the pivot cannot, all cursors leap past
        the first of those blocks to end, else they meet at the pivot, which is scored. A row ends without a pivot."""
        n, least = len(self.items), SCORE - 1e-9
        step, goal = self.keys.dtype.type(n + 1), int(least * UNIT)
        row = np.flatnonzero((self.head[terms] & LOW).sum(1) >= goal)  # the others have no pivot
        terms = terms[row].astype(self.keys.dtype)
        # A cursor is its next item and, in the low bits, its list's maximum; one at its end comes last and counts nothing.
        cursor, at, block = self.head[terms], self.first[terms], self.block_first[terms]
        self.counted["passages"] += len(row)
        width, gone = terms.shape[1], n << 32

        while len(row):
            near = np.sort(cursor, axis=1)
            reach = np.cumsum(near & LOW, axis=1) >= goal
            live = reach[:, -1]
            if not live.all():
                row, terms, cursor, at, block, near, reach = (x[live] for x in (row, terms, cursor, at, block, near, reach))
                if not len(row):
                    return
            pivot = near[np.arange(len(row)), reach.argmax(1)] >> 32
            upto = cursor < ((pivot + 1) << 32)[:, None]
            many = np.count_nonzero(upto, axis=1)
            own, starts = np.flatnonzero(upto), np.cumsum(many) - many
            p, t, b = np.repeat(pivot, many), terms.take(own), block.take(own)
            # the blocks that hold the first posting from the pivot on
            late = np.flatnonzero(self.block_item.take(b) < p)
            b[late] = np.searchsorted(self.block_keys, t[late] * step + p[late].astype(t.dtype))
            over = late[b[late] >= self.block_first.take(t[late] + 1)]
            b[over] = len(self.block_top) - 1  # no block: no maximum, no end
            block.put(own[late], b[late])
            tops, ends = self.block_top.take(b), self.block_item.take(b)
            tops[over], ends[over] = 0, n
            open_ = np.add.reduceat(tops, starts) >= least
            after = np.where(many < width, near[np.arange(len(row)), np.minimum(many, width - 1)] >> 32, n)
            target = np.where(open_, pivot, np.minimum(np.minimum.reduceat(ends, starts) + 1, after))
            self.counted["skipped"] += int(many[~open_].sum()) - int(np.count_nonzero(~np.repeat(open_, many)[over]))
            to = np.repeat(target, many)
            behind = np.flatnonzero((cursor.take(own) >> 32) < to)
            t, to, which = t[behind], to[behind], own[behind]
            left = self.last.take(t) >= to
            cursor.put(which[~left], gone)
            t, which = t[left], which[left]
            place = np.searchsorted(self.keys, t * step + to[left].astype(t.dtype))
            at.put(which, place)
            cursor.put(which, self.entry.take(place))
            if open_.any():
                self.counted["scored"] += int(np.count_nonzero(open_))
                meets = np.flatnonzero(np.repeat(open_, many) & ((cursor.take(own) >> 32) == p))
                which = own[meets]
                place = at.take(which)
                score = np.bincount(which // width, self.impacts.take(place), len(row))
                for i in np.flatnonzero(score >= least):
                    yield int(row[i]), int(pivot[i]), float(score[i])
                at.put(which, place + 1)
                cursor.put(which, np.where(self.last.take(terms.take(which)) > p[meets], self.entry.take(place + 1), gone))


@dataclass
class Index:
    terms: dict[str, int]
    classes: list[Postings]

    @classmethod
    def of(cls, rows: list[tuple[int, str]], df: dict[str, int] | None = None, n: int | None = None, mean: float | None = None) -> Index:
        """`df`, `n` and `mean`: document frequencies, number and mean length of all items, of which `rows` may be a part."""
        rows = sorted((i, t) for i, t in rows if words(t))
        texts = [words(t) for _, t in rows]
        if df is None:
            df, n, mean = {}, len(rows), sum(map(len, texts)) / max(1, len(rows))
            for w in texts:
                for x in set(w):
                    df[x] = df.get(x, 0) + 1
        terms = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}))}
        many = np.array([df[w] for w in terms], float)
        idf = np.log(1 + (n - many + 0.5) / (many + 0.5))
        groups: dict[int, list] = {}
        for row, w in zip(rows, texts, strict=True):
            groups.setdefault(half_of(len(w)), []).append(row)
        return cls(terms, [Postings.of(own, half, terms, idf, mean) for half, own in sorted(groups.items())])

    def search(self, texts: list[list[str]]) -> Iterator[tuple[int, int, float, float, float]]:
        """(text, item id, score, overlap of the question, of the answer) of every verified passage."""
        get = self.terms.get
        ids = np.fromiter(map(get, chain.from_iterable(texts), repeat(-1)), np.int64)
        lengths = np.array([len(t) for t in texts], np.int64)
        for c in self.classes:
            yield from self._search(c, ids, lengths)

    def _search(self, c: Postings, ids: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, float, float, float]]:
        empty, starts = len(self.terms), np.cumsum(lengths) - lengths
        halves = np.maximum(1, -(-lengths // c.half))
        begin = np.concatenate([[0], np.cumsum(halves)])
        doc_of = np.repeat(np.arange(len(lengths)), halves)
        half_at = np.repeat(begin[:-1], lengths) + (np.arange(len(ids)) - np.repeat(starts, lengths)) // c.half
        known = np.flatnonzero((ids >= 0) & (c.top[ids] > 0))
        pairs = np.sort(half_at[known] * empty + ids[known])
        pairs = pairs[np.diff(pairs, prepend=-1) > 0]  # a word counts once in a half
        at, term = np.divmod(pairs, max(1, empty))
        reach = np.bincount(at, c.top[term], begin[-1])
        follows = np.append(doc_of[1:] == doc_of[:-1], False)
        first_half = np.append(True, doc_of[1:] != doc_of[:-1])
        upper = reach + np.where(follows, np.append(reach[1:], 0.0), 0.0)
        # the last half of a text is part of the passage before it; without this much there is no first pivot
        chosen = np.flatnonzero((follows | first_half) & (upper >= SCORE - 1e-9))
        bounds = np.searchsorted(at, np.arange(begin[-1] + 1))
        size = bounds[chosen + 1 + follows[chosen]] - bounds[chosen]
        chosen = chosen[np.argsort(size, kind="stable")]
        for k in range(0, len(chosen), ABREAST):
            h = chosen[k : k + ABREAST]
            low, many = bounds[h], bounds[h + 1 + follows[h]] - bounds[h]
            column = np.arange(many.max())
            own = np.where(column < many[:, None], term[np.minimum(low[:, None] + column, len(term) - 1)], empty)
            own.sort(1)
            own[:, 1:][own[:, 1:] == own[:, :-1]] = empty
            for p, item, score in c.retrieved(own):
                d, place = doc_of[h[p]], (h[p] - begin[doc_of[h[p]]]) * c.half
                passage = ids[starts[d] + place : starts[d] + min(lengths[d], place + 2 * c.half)].tolist()
                over = []
                for part in c.items[item][1:]:
                    n = min(SHINGLE, len(part))
                    wanted = shingles(part, n)
                    over.append(len(wanted & shingles(passage, n)) / len(wanted))
                if min(over) >= OVERLAP:
                    yield int(d), c.items[item][0], score, over[0], over[1]


def _marked_once(docs: DataFrame, index: Index, name: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)
    schema = docs.schema
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            leaks = [list(x or []) for x in batch.column(name).to_pylist()]
            at = 0
            while at < len(texts):
                part, size, base = [], 0, at
                while at < len(texts) and (not part or size < 200_000):
                    part.append(words(texts[at]))
                    size += len(part[-1])
                    at += 1
                best: dict = {}
                for d, item, *figures in shared.value.search(part):
                    best[d, item] = max(best.get((d, item), []), figures)
                for (d, item), (score, question, answer) in sorted(best.items()):
                    leaks[base + d].append({"item_id": item, "score": score, "question": question, "answer": answer})
            place = batch.schema.get_field_index(name)
            yield pa.RecordBatch.from_arrays([pa.array(leaks, kind) if i == place else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return mapped(docs, run, schema)


def _tokenized(items: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [words(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.list_(pa.string()))], ["item_id", "text", "words"])

    return mapped(items, run, "item_id long, text string, words array<string>")


def marked(docs: DataFrame, benchmark: DataFrame, name: str = "leaks") -> DataFrame:
    """`docs` with a column of leaks: the benchmark items (item_id, score, question, answer) that some passage of the text repeats.

    A passage is two halves of a text, and begins at every half. Halves have 64 words for items of up to 64, 128 for those of
    up to 128 and so on, so that every item that lies whole in a text lies in a passage, and how long an item's passages
    are depends on no other item. Every passage queries the index: all items that reach the threshold are retrieved, and
    those count whose question and answer both have 80 % of their five-word shingles in the passage (parts under five
    words: the words themselves, in a row). Words are compared without case and punctuation.

    Document frequencies and the mean length are those of all items. An index is built of items of at most 500,000 words
    together (or of one longer item), which bounds the broadcast; a larger benchmark takes several, one pass over the
    documents each. Null or empty texts have no leaks; items with null id or without words are none; repeated items count
    once each. Texts of any length are read whole. Rows and other columns stay (a column of that name is replaced); no
    shuffle of documents; an empty benchmark marks nothing.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null").distinct()
    items = materialize(_tokenized(items).filter(F.size("words") > 0))
    out = docs.select(*(c for c in docs.columns if c.lower() != name.lower()), F.array().cast("array<struct<item_id:bigint,score:double,question:double,answer:double>>").alias(name))
    n, total = items.agg(F.count("*"), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    shards = ceil(total / (0.7 * INDEX_WORDS)) if total > INDEX_WORDS else min(1, n)
    df = items.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    df = materialize(df) if shards > 1 else df
    for s in range(shards):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == s)
        rows = [tuple(r) for r in own.select("item_id", "text").collect()]
        if rows:
            mine = own.select(F.explode("words").alias("word")).distinct()
            out = _marked_once(out, Index.of(rows, {r["word"]: r["df"] for r in df.join(mine, "word").collect()}, n, total / n), name)
    return out
