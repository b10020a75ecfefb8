"""Convolutional text classifier for toxicity, trained in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, mapped, materialize, memory
from .sampling import bounded_sample, held_out

#: Word buckets (one more is padding), embedding size, filter widths and filters of each width.
BUCKETS, SIZE, WIDTHS, FILTERS = 1 << 15, 8, (1, 2, 3), 8
#: A word's embedding is the sum of its bucket's and that of its first letters, so that inflected forms share one.
STEM = 4
#: Of a sample that a caller asks for, the characters of each document that training reads.
TRAIN_CHARS = 60_000
#: Rows of a training shard: one model learns from them in a row, before the shards' models are averaged. Passes over all shards.
SHARD_ROWS, EPOCHS = 16_000, 5
#: Rows of a shard, and words of them, that are held at a time to be learnt in another order.
HELD_ROWS, HELD_WORDS = 1000, 4_000_000
#: Parts of the rows whose scores by a model of the other parts set the thresholds, and steps of a score when they are counted.
FOLDS, STEPS = 3, 10_000
#: Toxic rows from which a language has a threshold of its own, and rows from which thresholds are learnt at all.
OWN_TOXIC, FEWEST = 10, 50
#: Words that are laid out at a time.
PART = 100_000
#: Documents of a training step, and the seed of the models' first values.
BATCH, SEED = 32, 7
#: Score at which a document counts as toxic, in every language.
LIMIT = 0.3
_WORD = re.compile(r"\w+")


class _Buckets(dict):
    """word -> bucket of the word * 2^16 + bucket of its first letters; remembers a bounded number of words."""

    def __missing__(self, word: str) -> int:
        hashed = lambda x: crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS
        bucket = hashed(word) << 16 | hashed(f"{word[:STEM]}*")
        if len(self) < 200_000:
            self[word] = bucket
        return bucket


def word_ids(text: str | None) -> np.ndarray:
    both = np.fromiter(map(memory("toxicity", _Buckets).__getitem__, _WORD.findall((text or "").lower())), np.int64)
    return np.stack([both >> 16, both & 0xFFFF], 1).astype(np.int32)


def _laid_out(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words with padding after each document, so that no filter sees two; starts and lengths of the documents."""
    pad = max(WIDTHS)
    lengths = np.array([len(d) for d in docs])
    starts = np.concatenate([[0], np.cumsum(lengths + pad)[:-1]]).astype(np.int64)
    ids = np.full((int((lengths + pad).sum()), 2), BUCKETS, np.int32)
    for d, at in zip(docs, starts, strict=True):
        ids[at : at + len(d)] = d
    return ids, starts, lengths


def _reduced(ufunc: np.ufunc, values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Over each document's own positions; zero for those without words."""
    out = np.zeros((len(starts), values.shape[1]), values.dtype)
    full = lengths > 0
    if full.any():
        bounds = np.stack([starts[full], starts[full] + lengths[full]], 1).ravel()
        out[full] = ufunc.reduceat(values, bounds)[::2]
    return out


@dataclass
class Model:
    """embedding (BUCKETS + 1, SIZE), a weight (width, SIZE, FILTERS) and a bias for each width, the output layer, the
    languages' word log-probabilities, and the threshold that each language's scores are bent to meet LIMIT at."""

    embedding: np.ndarray
    weights: list[np.ndarray]
    biases: list[np.ndarray]
    output: np.ndarray
    base: float
    languages: np.ndarray | None
    thresholds: np.ndarray | None

    def maps(self, ids: np.ndarray) -> list[np.ndarray]:
        """For each width (filter, word), without the bias."""
        x = self.embedding.take(ids[:, 0], 0)
        x += self.embedding.take(ids[:, 1], 0)
        values, out = np.concatenate([w.transpose(0, 2, 1).reshape(-1, SIZE) for w in self.weights]) @ x.T, []
        for w in self.weights:
            own, values = values[: len(w) * FILTERS], values[len(w) * FILTERS :]
            for j in range(1, len(w)):
                own[:FILTERS, :-j] += own[j * FILTERS : (j + 1) * FILTERS, j:]
            out.append(own[:FILTERS])
        return out

    def raw(self, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        full = (lengths > 0)[:, None]
        pooled = np.concatenate([np.maximum(_reduced(np.maximum, m.T, starts, lengths) + full * b, 0) for m, b in zip(self.maps(ids), self.biases, strict=True)], 1)
        return 1 / (1 + np.exp(-(pooled @ self.output + self.base)))

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """The probability, bent by two lines so that the threshold of the language that the words suggest falls on LIMIT."""
        ids, starts, lengths = _laid_out(docs)
        p = self.raw(ids, starts, lengths).astype(float)
        t = self.thresholds[self.language(ids, starts, lengths)]
        return np.where(p < t, LIMIT * p / t, LIMIT + (1 - LIMIT) * (p - t) / (1 - t)).clip(0, 1)

    def language(self, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return _reduced(np.add, self.languages[ids[:, 0]], starts, lengths).argmax(1)


def _started(seen: np.ndarray, sizes: np.ndarray, spoken: np.ndarray, rng: np.random.Generator) -> Model:
    """The first embedding coordinate starts as the log-odds of a bucket's document frequency in the classes. `seen`: by class
    and bucket; `sizes`: documents of the classes; `spoken`: words by bucket and language."""
    odds = np.log((seen[1] + 1) / (sizes[1] + 2)) - np.log((seen[0] + 1) / (sizes[0] + 2))
    spoken = spoken + 0.1
    spoken = np.log(spoken / spoken[:-1].sum(0)).astype(np.float32)
    spoken[BUCKETS] = 0
    embedding = rng.normal(0, 0.1, (BUCKETS + 1, SIZE)).astype(np.float32)
    embedding[:, 0] = odds / 2
    embedding[BUCKETS] = 0
    weights = [rng.normal(0, 0.3, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
    return Model(embedding, weights, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0.3, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), -1.0, spoken, np.full(spoken.shape[1], 0.5))


def _initial(docs: list[np.ndarray], y: np.ndarray, languages: list[str | None], rng: np.random.Generator) -> Model:
    seen = np.zeros((2, BUCKETS + 1))
    names = sorted({x for x in languages if x}) or ["und"]
    spoken = np.zeros((BUCKETS + 1, len(names)))
    for d, label, lang in zip(docs, y, languages, strict=True):
        seen[label, np.unique(d)] += 1
        if lang:
            unique, n = np.unique(d[:, 0], return_counts=True)
            spoken[unique, names.index(lang)] += n
    return _started(seen, np.array([len(y) - y.sum(), y.sum()]), spoken, rng)


def _winners(m: Model, docs: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each width the highest value of every document and filter, and the words (document, filter, place, 2) that gave it.
    At most PART words, or one piece of a longer document, are laid out at a time; pieces overlap by what a filter sees."""
    tops = [np.full((len(docs), FILTERS), -np.inf, np.float32) for _ in WIDTHS]
    words = [np.full((len(docs), FILTERS, w, 2), BUCKETS, np.int32) for w in WIDTHS]
    more, parts, size = max(WIDTHS) - 1, [[]], 0
    for k, d in enumerate(docs):
        for at in range(0, len(d), PART):
            n = min(PART, len(d) - at)
            if size and size + n > PART:
                parts.append([])
                size = 0
            parts[-1].append((k, d[at : at + n + more], n))
            size += n
    for part in filter(None, parts):
        ids, starts, _ = _laid_out([d for _, d, _ in part])
        docs_of = np.array([k for k, _, _ in part])
        for values, bias, top, word in zip(m.maps(ids), m.biases, tops, words, strict=True):
            won = np.array([start + values[:, start : start + n].argmax(1) for (_, _, n), start in zip(part, starts, strict=True)])
            high = values[np.arange(FILTERS), won] + bias
            better = high > top[docs_of]  # a part holds one piece of a document
            d, f = np.nonzero(better)
            top[docs_of[d], f] = high[d, f]
            word[docs_of[d], f] = ids[won[d, f][:, None] + np.arange(word.shape[2])]
    for top in tops:
        top[np.isneginf(top)] = 0
    return tops, words


def _step(m: Model, docs: list[np.ndarray], y: np.ndarray, rate: float, state: dict, size: int | None = None) -> None:
    """Backpropagation for one batch with Adagrad; only the places that won the pooling get gradients. `size`: documents that a
    batch counts as, so that those of a small one weigh no more."""

    def update(name: object, value: np.ndarray, grad: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        if name not in state:
            state[name] = np.full(value.shape, 0.1, np.float32)
        total = state[name][rows] + grad * grad
        state[name][rows] = total
        value[rows] -= (rate * grad / np.sqrt(total)).astype(np.float32)

    tops, words = _winners(m, docs)
    pooled = np.maximum(np.concatenate(tops, 1), 0)
    error = (1 / (1 + np.exp(-(pooled @ m.output + m.base))) - y).astype(np.float32) / (size or len(docs))
    back = error[:, None] * m.output * (pooled > 0)
    touched, moved = [], []
    for k, (w, word) in enumerate(zip(m.weights, words, strict=True)):
        g = back[:, k * FILTERS : (k + 1) * FILTERS]
        doc, filt = np.nonzero(g)
        own, g = word[doc, filt], g[doc, filt]
        x = (m.embedding[own[..., 0]] + m.embedding[own[..., 1]]) * g[:, None, None]
        grad_w, grad_b = np.zeros_like(w), np.bincount(filt, g, FILTERS)
        for f in range(FILTERS):
            grad_w[:, :, f] = x[filt == f].sum(0)
        touched += [own[..., 0].ravel(), own[..., 1].ravel()]
        moved += [(w.transpose(2, 0, 1)[filt] * g[:, None, None]).reshape(-1, SIZE)] * 2
        update(("w", k), w, grad_w)
        update(("b", k), m.biases[k], grad_b)
    update("o", m.output, pooled.T @ error)
    m.base -= rate * float(error.sum())
    ids = np.concatenate(touched)
    if len(ids):
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        rows, grad = ids[first], np.add.reduceat(np.concatenate(moved)[order], first, axis=0)
        grad[rows == BUCKETS] = 0
        update("e", m.embedding, grad, rows)


def _epoch(m: Model, docs: list[np.ndarray], y: np.ndarray, rate: float, rng: np.random.Generator, state: dict) -> None:
    order = rng.permutation(len(docs))
    for at in range(0, len(order), BATCH):
        batch = order[at : at + BATCH]
        _step(m, [docs[i] for i in batch], y[batch], rate, state)


def _rate(epoch: int) -> float:
    return 0.1 / (1 + epoch / 2)


def _fitted(docs: list[np.ndarray], y: np.ndarray, languages: list[str | None], rows: np.ndarray, epochs: int, seed: int) -> Model:
    rng, state = np.random.default_rng(seed), {}
    own = [docs[i] for i in rows]
    m = _initial(own, y[rows], [languages[i] for i in rows], rng)
    for k in range(epochs):
        _epoch(m, own, y[rows], _rate(k), rng, state)
    return m


def train(docs: list[np.ndarray], y: np.ndarray, languages: list[str | None], weight: np.ndarray | None = None, epochs: int = EPOCHS, folds: int = FOLDS, seed: int = SEED) -> Model:
    """All rows train. For each language, scores of rows by models that did not see them set the threshold with the best
    F1 (`weight`: how many rows of the corpus each stands for). A language with fewer than 10 toxic rows takes the one of all."""
    everything = np.arange(len(docs))
    m = _fitted(docs, y, languages, everything, epochs, seed)
    p, fold = np.zeros(len(docs)), np.random.default_rng(seed).permutation(len(docs)) % folds
    for k in range(folds if len(docs) >= FEWEST else 0):
        apart = everything[fold == k]
        other = _fitted(docs, y, languages, everything[fold != k], epochs, seed)
        p[apart] = other.raw(*_laid_out([docs[i] for i in apart]))
    guess, truth = m.language(*_laid_out(docs)), y
    share = np.ones(len(truth)) if weight is None else weight

    def best(which: np.ndarray) -> float:
        order = np.argsort(-p[which])
        hit, size = np.cumsum((truth * share)[which][order]), np.cumsum(share[which][order])
        f1 = 2 * hit / (size + hit[-1])
        k = int(f1.argmax())
        below = p[which][order][k + 1] if k + 1 < len(order) else 0.0
        return float(np.clip((p[which][order][k] + below) / 2, 0.02, 0.98))

    whole = best(np.ones(len(truth), bool)) if truth.any() and p.any() else 0.5
    m.thresholds = np.array([best(guess == k) if truth[guess == k].sum() >= OWN_TOXIC else whole for k in range(m.languages.shape[1])])
    return m


def _flat(m: Model) -> np.ndarray:
    """A copy of all that training moves, as rows of SIZE numbers: the embedding, then the filters and the output layer."""
    rest = np.concatenate([*(w.ravel() for w in m.weights), *m.biases, m.output, [m.base]])
    return np.concatenate([m.embedding, np.pad(rest, (0, -len(rest) % SIZE)).reshape(-1, SIZE)]).astype(np.float32)


def _model(flat: np.ndarray, languages: np.ndarray | None = None, thresholds: np.ndarray | None = None) -> Model:
    rest, at, parts = flat[BUCKETS + 1 :].ravel(), 0, []
    for shape in [*((w, SIZE, FILTERS) for w in WIDTHS), *((FILTERS,) for _ in WIDTHS), (FILTERS * len(WIDTHS),)]:
        n = int(np.prod(shape))
        parts.append(rest[at : at + n].reshape(shape).copy())
        at += n
    n = len(WIDTHS)
    return Model(flat[: BUCKETS + 1].copy(), parts[:n], parts[n : 2 * n], parts[-1], float(rest[at]), languages, thresholds)


def _sums(flat: np.ndarray) -> tuple[Model, dict]:
    """Adagrad's sums, laid out as a model and by the names of `_step`, over the same numbers."""
    s = _model(flat)
    return s, {"e": s.embedding, "o": s.output} | {(n, k): x for n, xs in (("w", s.weights), ("b", s.biases)) for k, x in enumerate(xs)}


#: Changes of a model travel as whole numbers of this size, so that their sum does not depend on the order.
GRAIN = 2.0**-20


def _unpacked(batch: pa.RecordBatch) -> list[np.ndarray]:
    codes = [np.frombuffer(x, "<i4") for x in batch.column("words").to_pylist()]
    return [np.stack([c >> 15, c & 0x7FFF], 1) for c in codes]


def _columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def _rows(rows: DataFrame) -> DataFrame | None:
    """Of labelled rows (doc_id, y, lang, text) the hashed words, dealt to shards of about SHARD_ROWS rows by a hash of id and
    words, in an order of their own; `fold` by the id, so rows of one id stay together. Written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pa.array([(d[:, 0] << 15 | d[:, 1]).astype("<i4").tobytes() for d in map(word_ids, batch.column("text").to_pylist())], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("doc_id", "y", "lang")] + [words], ["doc_id", "y", "lang", "words"])

    shards = -(-rows.count() // SHARD_ROWS)
    if not shards:
        return None
    place = F.xxhash64(F.lit("place"), "doc_id", "words")
    out = mapped(rows.select("doc_id", "y", "lang", "text"), run, "doc_id long, y int, lang string, words binary")
    out = out.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "doc_id", "words"), F.lit(shards)).cast("int")).withColumn("place", place)
    out = out.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int"))
    return materialize(out.repartitionById(shards, "shard").sortWithinPartitions("shard", "place", "doc_id", "lang"))


def _counted(rows: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over all rows: documents by fold, class and bucket; documents by fold and class; words by bucket and language, those of
    languages without a name in the last column."""
    own = {name: k for k, name in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, spoken = np.zeros((FOLDS, 2, BUCKETS + 1), np.int64), np.zeros((len(names) + 1, BUCKETS + 1), np.int64)
        for batch in batches:
            y, fold = _columns(batch, "y", "fold")
            for d, label, k, lang in zip(_unpacked(batch), y, fold, batch.column("lang").to_pylist(), strict=True):
                seen[k, label, np.unique(d)] += 1
                seen[k, label, BUCKETS] += 1  # padding's place counts the documents
                if lang:
                    unique, n = np.unique(d[:, 0], return_counts=True)
                    spoken[own.get(lang, len(names)), unique] += n
        both = np.concatenate([seen.reshape(-1, BUCKETS + 1), spoken])
        what, bucket = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(what, pa.int64()), pa.array(bucket, pa.int64()), pa.array(both[what, bucket])], ["what", "bucket", "n"])

    got = mapped(rows.select("y", "fold", "lang", "words"), run, "what long, bucket long, n long").groupBy("what", "bucket").agg(F.sum("n").alias("n")).toPandas()
    both = np.zeros((2 * FOLDS + len(names) + 1, BUCKETS + 1), np.int64)
    both[got["what"], got["bucket"]] = got["n"]
    seen = both[: 2 * FOLDS].reshape(FOLDS, 2, BUCKETS + 1)
    sizes = seen[:, :, BUCKETS].copy()
    seen[:, :, BUCKETS] = 0
    return seen, sizes, both[2 * FOLDS :].T


def _pass(rows: DataFrame, models: list[np.ndarray], number: int) -> list[np.ndarray]:
    """One pass over all rows for every model, which has Adagrad's sums beside it; the model at place k does not see fold k. A
    shard's rows move a copy of the model, in an order that differs from pass to pass; each row of the
    model then moves by the mean of the shards that moved it."""
    names = [f"v{i}" for i in range(2 * SIZE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(m.shape, np.int64) for m in models]
        times = [np.zeros(len(m), np.int64) for m in models]
        now, own, sums, waiting, held, size, rng = None, [], [], [], [], 0, np.random.default_rng(number)

        def step(k: int) -> None:
            _step(own[k], [d for d, _ in waiting[k]], np.array([y for _, y in waiting[k]]), _rate(number), sums[k][1], BATCH)
            waiting[k].clear()

        def learn() -> None:
            for i in rng.permutation(len(held)):
                d, label, fold = held[i]
                for k in range(len(models)):
                    if k != fold:
                        waiting[k].append((d, label))
                        if len(waiting[k]) == BATCH:
                            step(k)
            held.clear()

        def close() -> None:
            learn()
            for k, m in enumerate(own):
                if waiting[k]:
                    step(k)
                change = np.concatenate([_flat(m), _flat(sums[k][0])], 1) - models[k]
                moved = change.any(1)
                total[k][moved] += np.rint(change[moved].astype(float) / GRAIN).astype(np.int64)
                times[k][moved] += 1

        for batch in batches:
            for d, label, fold, shard in zip(_unpacked(batch), *_columns(batch, "y", "fold", "shard"), strict=True):
                if shard != now:
                    close()
                    now, own, sums = shard, [_model(m[:, :SIZE]) for m in models], [_sums(m[:, SIZE:]) for m in models]
                    waiting, size, rng = [[] for _ in models], 0, np.random.default_rng([number, shard])
                held.append((d, label, fold))
                size += len(d)
                if len(held) == HELD_ROWS or size > HELD_WORDS:
                    learn()
                    size = 0
        close()
        for k, n in enumerate(times):
            at = np.flatnonzero(n)
            columns = [np.full(len(at), k), at, n[at], *total[k][at].T]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), pa.int64()) for c in columns], ["model", "at", "n", *names])

    schema = ", ".join(f"{n} long" for n in ("model", "at", "n", *names))
    moves = mapped(rows.select("y", "fold", "shard", "words"), run, schema).groupBy("model", "at").agg(F.sum("n").alias("n"), *(F.sum(n).alias(n) for n in names)).toPandas()
    out = [m.copy() for m in models]
    for k, m in enumerate(out):
        own = moves[moves["model"] == k]
        m[own["at"].to_numpy()] += (own[names].to_numpy() * GRAIN / own["n"].to_numpy()[:, None]).astype(np.float32)
    return out


def _limits(rows: DataFrame, m: Model, others: list[np.ndarray]) -> np.ndarray:
    """The threshold of each language, from the scores of all rows by the model that did not see their fold."""
    apart = [_model(x, m.languages, m.thresholds) for x in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((m.languages.shape[1], STEPS + 1, 2), np.int64)
        for batch in batches:
            docs, (y, fold) = _unpacked(batch), _columns(batch, "y", "fold")
            for k in np.unique(fold):
                own = np.flatnonzero(fold == k)
                for part in _parts([docs[i] for i in own]):
                    laid = _laid_out([docs[i] for i in own[part]])
                    np.add.at(count, (m.language(*laid), (apart[k].raw(*laid) * STEPS).astype(int), y[own[part]]), 1)
        at = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (*at, count[at])], ["guess", "step", "y", "n"])

    got = mapped(rows.select("y", "fold", "words"), run, "guess long, step long, y long, n long").groupBy("guess", "step", "y").agg(F.sum("n").alias("n")).toPandas()
    count = np.zeros((m.languages.shape[1], STEPS + 1, 2))
    count[got["guess"], got["step"], got["y"]] = got["n"]

    def best(own: np.ndarray) -> float:
        steps = np.flatnonzero(own.sum(1))[::-1]
        hit, size = np.cumsum(own[steps, 1]), np.cumsum(own[steps].sum(1))
        k = int((2 * hit / (size + hit[-1])).argmax())
        below = steps[k + 1] + 1 if k + 1 < len(steps) else 0
        return float(np.clip((steps[k] + below) / 2 / STEPS, 0.02, 0.98))

    whole = best(count.sum(0)) if count[:, :, 1].any() else 0.5
    return np.array([best(x) if x[:, 1].sum() >= OWN_TOXIC else whole for x in count])


def _parts(docs: list[np.ndarray]) -> Iterator[slice]:
    """Documents in a row with at most PART words together, or one alone."""
    start = size = 0
    for at, d in enumerate(docs):
        if at > start and size + len(d) > PART:
            yield slice(start, at)
            start, size = at, 0
        size += len(d)
    if docs:
        yield slice(start, len(docs))


def _trained(rows: DataFrame) -> Model | None:
    """Trains on all labelled rows, on the executors: shards learn side by side from one model and are averaged after each pass
    (local SGD). Only models, counts by bucket and counts by score reach the driver."""
    table = _rows(rows)
    if table is None:
        return None
    toxic = table.filter(F.col("lang") != "").groupBy("lang").agg(F.sum("y").alias("n"))
    names = sorted(r["lang"] for r in toxic.filter(F.col("n") >= OWN_TOXIC).collect())
    seen, sizes, spoken = _counted(table, names)
    if names and not spoken[:, -1].any():
        spoken = spoken[:, :-1]
    folds = FOLDS if sizes.sum() >= FEWEST else 0
    counts = [(seen.sum(0) - seen[k], sizes.sum(0) - sizes[k]) for k in range(folds)] + [(seen.sum(0), sizes.sum(0))]
    started = [_started(*c, spoken, np.random.default_rng(SEED)) for c in counts]
    if not folds:  # all rows then train the model at place 0, as no fold has the number -1
        table = table.withColumn("fold", F.lit(-1))
    flat = [np.pad(_flat(m), ((0, 0), (0, SIZE)), constant_values=0.1) for m in started]
    for k in range(EPOCHS):
        flat = _pass(table, flat, k)
    flat = [x[:, :SIZE] for x in flat]
    m = _model(flat[-1], started[-1].languages, started[-1].thresholds)
    if folds:
        m.thresholds = _limits(table, m, flat[:folds])
    forget(table)
    return m


def fit(docs: DataFrame, labels: DataFrame, rows: int | None = None) -> Model | None:
    """Learns from every labelled document outside the held-out fold, of whatever length; None without any. A document with
    several labels counts as toxic if one says so; null labels do not count. Of rows that repeat a doc_id all are learnt. A
    language with fewer than OWN_TOXIC toxic rows takes the threshold of all.

    A caller may ask for a sample instead, which is trained on the driver: at most `rows` documents of each class, of each at
    most TRAIN_CHARS characters, and of rows that repeat a doc_id one, so the bound holds for rows."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("y"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    if rows is None:
        # by sort and merge whatever the sizes, so that small runs show what large ones shuffle
        return _trained(own.filter(~held_out(F.col("doc_id"))).join(known.hint("merge"), "doc_id"))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    sample = bounded_sample(known, "y", rows, "toxicity").toPandas()
    ids = docs.sparkSession.createDataFrame(sample, known.schema)  # 2 * rows at most
    own = own.withColumn("text", F.substring("text", 1, TRAIN_CHARS))
    texts = own.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), F.min(F.struct("text", "lang")).alias("row")).select("doc_id", "y", "row.*").toPandas()
    if texts.empty:
        return None
    texts = texts.sort_values("doc_id").reset_index(drop=True)
    y = texts["y"].to_numpy().astype(int)
    share = np.array([sizes.get(k, 0) / max(1, (y == k).sum()) for k in (0, 1)])[y]
    return train([word_ids(t) for t in texts["text"]], y, [x if isinstance(x, str) else None for x in texts["lang"]], share)


def scored(docs: DataFrame, model: Model | None, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """`docs` with two columns: the score (0 to 1) and what it predicts (1 from LIMIT on), from the whole text alone.

    Null and empty texts score as a text without words; without a model, that is without any label, all score 0. Rows,
    and other columns, stay as they are; columns of the two names are replaced. No shuffle; a task holds the words of a
    few documents and the model of about 2 MB.
    """
    out = docs.select(*(c for c in docs.columns if c.lower() not in (score.lower(), predicted.lower())))
    schema = out.withColumn(score, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, scores, at = batch.column("text").to_pylist(), [], 0
            while at < len(texts):
                part, size = [], 0
                while at < len(texts) and (not part or size < PART):
                    part.append(word_ids(texts[at]))
                    size += len(part[-1])
                    at += 1
                scores.append(model.score(part) if model else np.zeros(len(part)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores) if scores else [], pa.float64())], [*batch.schema.names, score])

    return mapped(out, run, schema).withColumn(predicted, F.when(F.col(score) >= LIMIT, 1).otherwise(0))
