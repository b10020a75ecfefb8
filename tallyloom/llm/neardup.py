"""Near-duplicate classes by BagMinHash over multisets of word shingles."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, mapped, materialize, memory

#: Words of a shingle, least weighted Jaccard similarity, bands and rows of the signature: a pair at 0.8 shares no band
#: with probability (1 - 0.8^5)^25 = 5e-5.
SHINGLE, LEAST, BANDS, ROWS = 5, 0.8, 25, 5
#: Members of a block, two of which a task holds at most, and those that all first cells of a large family share.
BLOCK, COMMON = 512, 16
_WORD = re.compile(r"\w+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """word -> 64-bit hash; remembers a bounded number of words."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < 200_000:
            self[word] = value
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def words(text: str | None) -> list[str]:
    """Without case and punctuation."""
    return _WORD.findall((text or "").lower())


def bag(w: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed shingles and how often each occurs; fewer than five words are one shingle, none have none."""
    if not w:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(memory("neardup", _Hashes).__getitem__, w), np.uint64, len(w))
    n = min(SHINGLE, len(w))
    total = np.zeros(len(w) - n + 1, np.uint64)
    for j in range(n):
        total = mixed(total + h[j : len(w) - n + 1 + j] + _ODD)
    return np.unique(total, return_counts=True)


def signature(elements: np.ndarray, weights: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """BagMinHash of whole-number weights: every element owns Poisson processes over the weight axis, one for each of
    the intervals [0, 1), [1, 2), [2, 4), [4, 8) ... that its weight reaches; their points carry a time, a weight and a
    slot, those above the element's weight do not count, and a slot keeps its first time. Two bags agree in a slot with
    the probability of their weighted Jaccard similarity. Points are drawn up to a time that all slots reach, as a rule,
    with about ten points for each slot however many elements there are; if not, up to a later one."""
    levels, low = [(elements, 1, np.ones(len(elements)))], 1
    while (more := weights > low).any():
        levels.append((mixed(elements[more] + np.uint64(low)), low, np.minimum(weights[more], 2 * low) - low))
        low *= 2
    until = (np.log(size) + 3) / weights.sum()
    while True:
        out = np.full(size, np.inf)
        for seed, width, limit in levels:
            near = _gaps(mixed(seed + _ODD)) <= until * size * width  # most elements' first points come too late
            seed, limit, mean = seed[near], limit[near], until * size * width
            draws, times = int(mean + 6 * np.sqrt(mean) + 8), None
            while len(seed) and (times is None or (times[:, -1] <= until).any()):
                random = mixed(seed[:, None] + np.arange(1, draws + 1, dtype=np.uint64) * _ODD)
                times, draws = np.cumsum(_gaps(random), 1) / (size * width), 2 * draws
            if len(seed):
                row, at = np.nonzero(times <= until)
                other = mixed(random[row, at] + np.uint64(1))
                counts = (other >> np.uint64(32)) * 2.0**-32 * width < limit[row]
                slots = ((other & np.uint64(0xFFFFFFFF)) % np.uint64(size)).astype(np.int64)
                np.minimum.at(out, slots[counts], times[row, at][counts])
        if np.isfinite(out).all():
            return out
        until *= 2


def _gaps(random: np.ndarray) -> np.ndarray:
    """Exponential times from random numbers."""
    return -np.log(((random >> np.uint64(11)) + 0.5) * 2.0**-53)


def bands(sign: np.ndarray) -> np.ndarray:
    rows = sign.view(np.uint64).reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        out = mixed(out * _ODD + rows[:, j])
    return out.view(np.int64)


def similarity(a: str | None, b: str | None) -> float:
    """Weighted Jaccard of the shingle multisets; 0 without words."""
    (x, n), (y, m) = bag(words(a)), bag(words(b))
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = np.minimum(n[i], m[j]).sum()
    return float(both / (n.sum() + m.sum() - both)) if both else 0.0


def _signed(docs: DataFrame, wordless: bool) -> DataFrame:
    """doc_id, mark, text_key (of the words; without any, of the text if `wordless`, else null), bands."""
    schema = pa.schema({"doc_id": pa.int64(), "mark": pa.int64(), "text_key": pa.binary(), "bands": pa.list_(pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = [], []
            for text in batch.column("text").to_pylist():
                w = words(text)
                known = " ".join(w) if w else "\0" + text if wordless and text is not None else None
                keys.append(None if known is None else xxhash.xxh3_128_digest(known.encode("utf-8", "surrogatepass")))
                found.append(bands(signature(*bag(w))) if w else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int64()))], schema=schema)

    return mapped(docs, run, "doc_id long, mark long, text_key binary, bands array<long>")


def forest(texts: list[str | None]) -> np.ndarray:
    """For each text the place of the first text of its component, where links are similarities of 0.8 or more.

    A text is compared with all others at once, through an inverted index of shingles. Once a text is done all its links
    are known, so the work ends as soon as all texts not yet done are of one component: copies of one text take a step
    or two, and texts off the largest component are those compared with the rest."""
    if len(texts) == 2:
        return np.array([0, 0 if similarity(*texts) >= LEAST - 1e-12 else 1])
    bags = [bag(words(t)) for t in texts]
    sizes = np.array([n.sum() for _, n in bags])
    owner = np.repeat(np.arange(len(bags)), [len(e) for e, _ in bags])
    flat, counts = np.concatenate([e for e, _ in bags]), np.concatenate([n for _, n in bags])
    order = np.argsort(flat, kind="stable")
    flat, owner, counts = flat[order], owner[order], counts[order]
    root, open_ = np.arange(len(bags)), np.ones(len(bags), bool)
    while True:
        names, many = np.unique(root[open_], return_counts=True)
        if len(names) < 2:
            return root
        x = int(np.flatnonzero(open_ & (root != names[many.argmax()]))[0])
        open_[x] = False
        elements, n = bags[x]
        low, high = np.searchsorted(flat, elements), np.searchsorted(flat, elements, "right")
        reach = high - low
        places = np.repeat(low - (np.cumsum(reach) - reach), reach) + np.arange(reach.sum())
        both = np.bincount(owner[places], np.minimum(counts[places], np.repeat(n, reach)), len(bags))
        linked = np.unique(root[both >= (LEAST - 1e-12) * (sizes + sizes[x] - both)])
        linked = np.union1d(linked, root[x : x + 1])
        root[np.isin(root, linked)] = linked[0]


def _linked(cells: DataFrame) -> DataFrame:
    """Edges (a, b) that connect, within each cell (cell, member, text), what similarities connect there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, texts = None, [], []

        def told() -> pa.RecordBatch:
            root = forest(texts) if len(ids) > 1 else np.zeros(len(ids), np.int64)
            own = np.array(ids, np.int64)
            moved = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(own[moved]), pa.array(own[root[moved]])], ["a", "b"])

        for batch in batches:
            for cell, member, text in zip(*(batch.column(n).to_pylist() for n in ("cell", "member", "text")), strict=True):
                if cell != at:
                    if len(ids) > 1:
                        yield told()
                    at, ids, texts = cell, [], []
                if not ids or ids[-1] != member:
                    ids.append(member)
                    texts.append(text)
        if len(ids) > 1:
            yield told()

    dealt = cells.select("cell", "member", "text").repartition("cell").sortWithinPartitions("cell", "member")
    return mapped(dealt, run, "a long, b long")


def _met_again(large: DataFrame, found: DataFrame) -> DataFrame:
    """member, cell: in each large family (member, family, n) the members off its largest component so far, in blocks, meet each
    other and every block of that component."""
    now = large.join(found.withColumnRenamed("node", "member"), "member", "left").withColumn("component", F.coalesce("component", "member"))
    parts = now.groupBy("family", "component").agg(F.count("*").alias("size"))
    main = parts.groupBy("family").agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.max("size").alias("inside"))
    now = now.join(main, "family").filter("inside < n")
    inner, outer = F.ceil(F.col("inside") / BLOCK).cast("int"), F.ceil((F.col("n") - F.col("inside")) / BLOCK).cast("int")
    draw = lambda seed, m: F.pmod(F.xxhash64("member", F.lit(seed)), m).cast("int")
    off, own = F.col("component") != F.col("main"), draw(3, outer)
    name = lambda x, y: F.concat_ws(" ", F.least(x, y).cast("string"), F.greatest(x, y).cast("string"))
    with_main = lambda x, y: F.concat_ws(" ", x.cast("string"), F.lit("main"), y.cast("string"))
    cells = F.when(off, F.concat(F.transform(F.sequence(F.lit(0), outer - 1), lambda j: name(own, j)), F.transform(F.sequence(F.lit(0), inner - 1), lambda j: with_main(own, j)))).otherwise(F.transform(F.sequence(F.lit(0), outer - 1), lambda i: with_main(i, draw(4, inner))))
    return now.select("member", F.explode(cells).alias("cell")).join(large.select("member", "family"), "member").select("member", F.concat_ws(" ", "family", "cell").alias("cell"))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of a graph of edges (a, b), by alternating stars: in each round the neighbours
    above a node, then those below it, are hung on the smallest of them, until nothing changes. Sums are partial before
    they are dealt out, joins are plain equi-joins, and only a count and a checksum reach the driver."""
    edges = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        check = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if check == mark or not check[0]:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
        mark = check
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        hung = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = hung.groupBy("u").agg(F.min("v").alias("m"))
        pairs = hung.join(low, "u")
        small = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(pairs.select("u", F.col("m").alias("v"))).filter("u <> v")
        last, edges = edges, materialize(small.distinct())
        forget(last)


def classes(docs: DataFrame, wordless: bool = False) -> DataFrame:
    """doc_id, class_id: one row for each row of `docs`; a class is a connected component of texts with a weighted
    Jaccard similarity of 0.8 or more over five-word shingles, named by its smallest doc_id.

    Equal texts (but for case and punctuation) are one member from the start, so copies never meet in pairs. Members
    that share a band fall in a bucket, buckets that share members in a family. A family of up to 1024 members is one
    cell, whose texts are compared in one task with an inverted index, exactly. A larger one is first cut into cells of
    about 512 members, each with about 16 common ones, which joins most of a class; then the members off its largest
    component so far, in blocks, meet each other and every block of that component. So every pair of a family that could
    join two classes is compared, no group is capped, no task holds more than two blocks, and no pairs are emitted, only
    edges of a forest. What travels in that last step grows, for each family, with the number of its members times the
    number of blocks off the component, so with the square of a family whose members are mostly under 0.8.

    Texts without words (if `wordless`, only null ones; equal ones are a class), and null doc_ids, are alone (class_id is
    doc_id). Rows that repeat a doc_id are members by their own texts. Of very long texts a task holds those of one cell.
    Other columns are not read; an empty table gives no rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    signed = materialize(_signed(own, wordless))
    members = signed.filter("text_key is not null and doc_id is not null").groupBy("text_key").agg(F.min(F.struct("doc_id", "mark")).alias("place"), F.first("bands").alias("bands"))
    members = materialize(members.select(F.monotonically_increasing_id().alias("member"), "text_key", "place.doc_id", "place.mark", "bands"))
    buckets = members.select("member", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min("member").alias("least")).filter("n > 1").select("bucket", "least")
    stars = buckets.join(shared, "bucket").filter("member <> least").select(F.col("least").alias("a"), F.col("member").alias("b")).distinct()
    families = components(stars).select(F.col("node").alias("member"), F.col("component").alias("family"))
    families = materialize(families.unionByName(families.select(F.col("family").alias("member"), "family").distinct()))
    size = families.groupBy("family").agg(F.count("*").alias("n"))
    placed = members.select("member", "doc_id", "mark").join(families.join(size, "family"), "member")
    texts = own.join(placed.hint("merge"), ["doc_id", "mark"]).groupBy("member").agg(F.first("text").alias("text"), F.first("family").alias("family"), F.first("n").alias("n"))
    texts = materialize(texts)
    draw = lambda seed, m: F.pmod(F.xxhash64("member", F.lit(seed)), m).cast("int")
    blocks = F.when(F.col("n") <= 2 * BLOCK, 1).otherwise(F.ceil(F.col("n") / BLOCK))
    common = (F.col("member") == F.col("family")) | (draw(1, F.col("n")) < COMMON)
    everywhere = F.when(common & (blocks > 1), F.sequence(F.lit(0), blocks.cast("int") - 1)).otherwise(F.array(draw(2, blocks)))
    edges = materialize(_linked(texts.withColumn("cell", F.explode(everywhere)).withColumn("cell", F.concat_ws(" ", "family", "cell"))))
    found = materialize(components(edges))
    large = texts.filter(F.col("n") > 2 * BLOCK)
    if not large.isEmpty():
        more = _linked(large.select("member", "text").join(_met_again(large.select("member", "family", "n"), found), "member"))
        found = materialize(components(edges.unionByName(more)))
    named = members.select("text_key", "member", "doc_id").join(found.withColumnRenamed("node", "member"), "member", "left").withColumn("component", F.coalesce("component", "member"))
    named = named.join(named.groupBy("component").agg(F.min("doc_id").alias("class_id")), "component").select("text_key", "class_id")
    return signed.select("doc_id", "text_key").join(named, "text_key", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))
