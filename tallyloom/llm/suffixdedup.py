"""Removal of repeated passages by prefix-partitioned suffix trees over words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, materialize, memory

#: Words of a window, and of the part of its prefix that names its group.
WINDOW, GRAM = 50, 15
#: Runs of a group beyond which it is split, and words that one tree holds at most (but for a longer run).
GROUP_ROWS, TREE_WORDS = 5_000, 400_000
_WORD = re.compile("[^\x20\x09-\x0d]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class _Hashes(dict):
    """word -> 64-bit hash; remembers a bounded number of words."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < 200_000:
            self[word] = value
        return value


def words(text: str | None) -> list[str]:
    return _WORD.findall(text or "")


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _sliding(ufunc: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """Over every `width` neighbours, by doubling."""
    done = 1
    while 2 * done <= width:
        x, done = ufunc(x[:-done], x[done:]), 2 * done
    return ufunc(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def anchors(w: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each window the place of its smallest hashed gram (the first of equal ones), and that hash. Equal windows have
    equal grams at equal places, so a window's group follows from its words alone; neighbours mostly share theirs."""
    if len(w) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.fromiter(map(memory("suffixdedup", _Hashes).__getitem__, w), np.uint64, len(w))
    total = np.concatenate([[np.uint64(0)], np.cumsum(h * _powers(len(h), _ODD), dtype=np.uint64)])
    gram = (total[GRAM:] - total[:-GRAM]) * _powers(len(h) - GRAM + 1, _INVERSE)
    gram ^= gram >> np.uint64(29)
    gram *= np.uint64(0xBF58476D1CE4E5B9)
    gram ^= gram >> np.uint64(32)
    width = WINDOW - GRAM + 1
    least = _sliding(np.minimum, gram, width)
    spots = np.flatnonzero(_sliding(np.maximum, np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)]), width) == gram)
    begin = np.arange(len(least))
    place = spots[np.searchsorted(spots, begin)]
    while (wrong := gram[place] != least).any():  # a spot of a window before; the next one, then
        place[wrong] = spots[np.searchsorted(spots, place[wrong] + 1)]
    return place, least.view(np.int64)


def _runs(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First windows and lengths of the runs of windows with one anchor."""
    cuts = np.flatnonzero(np.diff(place)) + 1
    begin = np.concatenate([[0], cuts]) if len(place) else cuts
    return begin, np.diff(np.append(begin, len(place)))


def _extended(w: list[str], place: int, begin: int, n: int) -> list[tuple[int, int, int]]:
    """(group, first window, windows): a run whose anchor is too common, named by more of its words. A window with the
    anchor in its first half has words to spare on the right, another on the left; equal windows choose alike."""
    half = (WINDOW - GRAM) // 2
    cut = min(max(place - half, begin), begin + n)
    out = []
    for at, k, words_ in ((begin, cut - begin, w[place - half - 1 : place + GRAM]), (cut, begin + n - cut, w[place : place + WINDOW - half])):
        if k:
            name = xxhash.xxh3_64_intdigest(" ".join(words_).encode("utf-8", "surrogatepass"), seed=len(words_))
            out.append((name - (1 << 64) if name >> 63 else name, at, k))
    return out


def _surveyed(docs: DataFrame) -> DataFrame:
    """doc_id, mark, text_key, groups, runs: the distinct hashes of the anchors of runs of windows, and how many runs each has."""
    schema = pa.schema({"doc_id": pa.int64(), "mark": pa.int64(), "text_key": pa.binary(), "groups": pa.list_(pa.int64()), "runs": pa.list_(pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, mark, text in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "mark", "text")), strict=True):
                w = words(text)
                place, group = anchors(w)
                own, many = np.unique(group[_runs(place)[0]], return_counts=True)
                rows.append((doc_id, mark, xxhash.xxh3_128_digest(" ".join(w).encode("utf-8", "surrogatepass")) if len(w) >= WINDOW else None, own, many))
            yield _made(rows, schema)

    return mapped(docs, run, "doc_id long, mark long, text_key binary, groups array<long>, runs array<long>")


def _runs_of(joined: DataFrame) -> DataFrame:
    """The runs (doc_id, mark, group, common, begin, windows, words) of each document whose anchors are among its `hot` ones."""
    schema = pa.schema({"doc_id": pa.int64(), "mark": pa.int64(), "group": pa.int64(), "common": pa.bool_(), "begin": pa.int64(), "windows": pa.int32(), "words": pa.string()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, mark, text, hot in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "mark", "text", "hot")), strict=True):
                w, common = words(text), {x["group"]: x["common"] for x in hot}
                place, group = anchors(w)
                for begin, n in zip(*(x.tolist() for x in _runs(place)), strict=True):
                    if (often := common.get(int(group[begin]))) is not None:
                        parts = _extended(w, int(place[begin]), begin, n) if often else [(int(group[begin]), begin, n)]
                        rows += [(doc_id, mark, name, often, at, k, " ".join(w[at : at + k - 1 + WINDOW])) for name, at, k in parts]
                if len(rows) >= 5000:
                    yield _made(rows, schema)
                    rows = []
            yield _made(rows, schema)

    return mapped(joined, run, "doc_id long, mark long, group long, common boolean, begin long, windows int, words string")


def _made(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _cut(joined: DataFrame) -> DataFrame:
    """doc_id, text (the words left, joined by a blank), n_words, spans: from the starts and stops of windows in `hits`."""
    schema = pa.schema({"doc_id": pa.int64(), "text": pa.string(), "n_words": pa.int64(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, copy, hits in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "text", "copy", "hits")), strict=True):
                w, spans, left = words(text), [], []
                windows = [(0, len(w) - WINDOW + 1)] if copy else sorted(zip(hits[::2], hits[1::2], strict=True)) if hits else []
                for start, stop in windows:
                    if spans and start <= spans[-1]["stop"]:
                        spans[-1]["stop"] = max(spans[-1]["stop"], stop - 1 + WINDOW)
                    else:
                        spans.append({"start": start, "stop": stop - 1 + WINDOW})
                at = 0
                for span in spans:
                    left += w[at : span["start"]]
                    at = span["stop"]
                rows.append((doc_id, " ".join(left + w[at:]), len(w), spans))
            yield _made(rows, schema)

    return mapped(joined, run, "doc_id long, text string, n_words long, spans array<struct<start:long,stop:long>>")


class Tree:
    """The tree of some suffixes of a row of words down to `depth`, as the order of its leaves and, between neighbours, the
    depth of the node that parts them (the words that both begin with): an internal node is a stretch of leaves
    whose neighbours are parted no higher. The words are compared themselves, by their places in a dictionary.

    The leaves are ordered by ranks of 1, 2, 4 ... words, each the order of pairs of the one before, and the depths
    are read off the same ranks, the longest first."""

    def __init__(self, words_: np.ndarray, starts: np.ndarray, depth: int = WINDOW):
        ranks, done = {1: np.unique(words_, return_inverse=True)[1].astype(np.int64)}, 1
        while 2 * done <= depth:
            name = ranks[done]
            ranks[2 * done] = np.unique(name[:-done] * (len(name) + 1) + name[done:], return_inverse=True)[1].astype(np.int64)
            done *= 2
        parts, at = [], 0
        for length in sorted(ranks, reverse=True):
            if at + length <= depth:
                parts.append(ranks[length][starts + at])
                at += length
        self.leaves = np.lexsort(parts[::-1])
        ordered = starts[self.leaves]
        left, right = ordered[:-1], ordered[1:]
        self.depths = np.zeros(len(left), np.int64)
        for length in sorted(ranks, reverse=True):
            room = self.depths + length <= depth
            a, b = (np.where(room, x + self.depths, 0) for x in (left, right))
            self.depths += length * (room & (ranks[length][a] == ranks[length][b]))

    def nodes(self, depth: int = WINDOW) -> np.ndarray:
        """The highest nodes of at least that depth, single leaves among them: where each begins among the leaves."""
        return np.concatenate([[0], np.flatnonzero(self.depths < depth) + 1]) if len(self.leaves) else np.zeros(0, np.int64)


def _trees(runs: DataFrame) -> DataFrame:
    """doc_id, mark, hits (starts and stops of windows that begin in a document with a smaller id), firsts (of groups that no one
    tree holds: the windows that are the first of their node in this tree, by the 128-bit hash of their words).

    `runs` come sorted by group. A tree takes the suffixes of as many groups, or of as much of one, as fit; it never takes
    more, whatever is in a group, and what several trees know of one group is brought together afterwards."""
    firsts = pa.list_(pa.struct([("node", pa.binary()), ("at", pa.int64())]))
    schema = pa.schema({"doc_id": pa.int64(), "mark": pa.int64(), "hits": pa.list_(pa.int64()), "firsts": firsts})
    most = TREE_WORDS

    def repeated(rows: list[tuple], texts: list[list[str]]) -> np.ndarray:
        """Flags, by run and window: all leaves of a deep node but those of its smallest document."""
        lengths, numbers = np.array([len(t) for t in texts]), {}
        flat = np.fromiter((numbers.setdefault(w, len(numbers)) for w in chain.from_iterable(texts)), np.int64, lengths.sum())
        counts = np.array([r[5] for r in rows])
        run = np.repeat(np.arange(len(rows)), counts)
        starts = (np.cumsum(lengths) - lengths)[run] + np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)
        tree = Tree(flat, starts)  # windows of different groups differ in their words, so one tree serves all its groups
        doc, begin = np.array([r[2] for r in rows])[run][tree.leaves], tree.nodes()
        least = np.repeat(np.minimum.reduceat(doc, begin), np.diff(np.append(begin, len(doc))))
        flags = np.zeros(len(doc), bool)
        flags[tree.leaves] = doc > least
        return flags

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (group, splits, doc_id, mark, begin, windows, words)
        size, begun = 0, None  # a group that a tree before has begun

        def tell(goes_on: bool) -> pa.RecordBatch:
            nonlocal held, size, begun
            texts = [r[6].split(" ") for r in held]
            flags, at, out, last = repeated(held, texts), 0, [], held[-1][0]
            for (group, splits, doc_id, mark, begin, n, _), text in zip(held, texts, strict=True):
                own = flags[at : at + n]
                at += n
                edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
                new = []
                if splits > 1 or group == begun or (goes_on and group == last):
                    for k in np.flatnonzero(~own).tolist():
                        new.append({"node": xxhash.xxh3_128_digest(" ".join(text[k : k + WINDOW]).encode("utf-8", "surrogatepass")), "at": begin + k})
                if len(edge) or new:
                    out.append((doc_id, mark, (edge + begin).tolist(), new))
            held, size, begun = [], 0, last if goes_on else None
            return _made(out, schema)

        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("group", "splits", "doc_id", "mark", "begin", "windows", "words")), strict=True):
                if held and size + row[5] + WINDOW > most:
                    yield tell(row[0] == held[-1][0])
                held.append(row)
                size += row[5] + WINDOW
        if held:
            yield tell(False)

    columns = runs.select("group", "splits", "doc_id", "mark", "begin", "windows", "words")
    return mapped(columns, run, "doc_id long, mark long, hits array<long>, firsts array<struct<node:binary,at:long>>")


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_words, spans: what is left of every text, its words joined by a blank, when each word goes that is
    covered by a window of 50 words whose words also begin in a document with a smaller doc_id; how many words there were,
    and which spans of them went. Windows are judged on the input.

    Suffixes (the windows' starts) are partitioned by prefixes of 15 to 50 words: up to the end of the smallest hashed
    15-gram of the window, so that neighbours share a group and travel together as a run. Groups that occur in one document
    only hold no repeat and end there. A group of over 5,000 runs takes 33 words instead of 15, which parts what merely
    shares a line. Each task builds the trees of its groups, of a bounded number of words each; the nodes 50 words deep
    hold what repeats. A group that is still larger (copies of a passage share any prefix) is dealt into parts and trees,
    whose deep nodes, each with its smallest document, are merged by a grouping; a node meets as many rows there as
    trees hold it, not as many as there are copies. A document whose words equal those of one with a smaller id goes
    whole, before all that.

    Null or short texts keep all words; of very long ones a task holds one at a time. Rows that repeat a doc_id do not
    repeat each other and are judged each by its own text; a null doc_id neither repeats others nor is repeated. Other
    columns are not read; an empty table gives no rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    row = ["doc_id", "mark"]
    survey = materialize(_surveyed(own))
    known = survey.filter("doc_id is not null and text_key is not null")
    first = known.groupBy("text_key").agg(F.min("doc_id").alias("least"))
    copies = materialize(known.select(*row, "text_key").join(first, "text_key").filter("doc_id > least").select(*row).distinct())
    single = known.select(*row, "groups", "runs").join(copies, row, "left_anti").select(*row, F.inline(F.arrays_zip("groups", "runs"))).withColumnRenamed("groups", "group")
    met = single.groupBy("group").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.sum("runs").alias("n")).filter("low < high").select("group", (F.col("n") > GROUP_ROWS).alias("common"))
    hot = single.select(*row, "group").join(met, "group").groupBy(*row).agg(F.collect_set(F.struct("group", "common")).alias("hot"))
    runs = materialize(_runs_of(own.join(hot.hint("merge"), row).select(*row, "text", "hot")))
    large = runs.filter("common").groupBy("group").agg(F.count("*").alias("n")).filter(F.col("n") > GROUP_ROWS).select("group", F.ceil(F.col("n") / GROUP_ROWS).cast("int").alias("splits"))
    large = materialize(large)  # so its size is known before the join, and if it is small the runs need no exchange for it
    dealt = runs.join(large, "group", "left").withColumn("splits", F.coalesce("splits", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("doc_id", "begin"), F.col("splits"))).repartition("group", "part").sortWithinPartitions("group", "part", "doc_id")
    found = materialize(_trees(dealt))
    firsts = found.select(*row, F.inline("firsts"))
    least = firsts.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1")
    again = firsts.join(least, "node").filter("doc_id > least").select(*row, F.array("at", F.col("at") + 1).alias("hits"))
    hits = found.select(*row, "hits").filter(F.size("hits") > 0).unionByName(again)
    hits = hits.groupBy(*row).agg(F.flatten(F.collect_list("hits")).alias("hits"))
    about = copies.withColumn("copy", F.lit(True)).join(hits, row, "full")
    return _cut(own.join(about.hint("merge"), row, "left").select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "hits"))
