"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped
from .sampling import bounded_sample, held_out

#: State size of each direction, bytes of a piece (states start anew in each), pieces that run side by side.
STATE, STEPS, ABREAST = 8, 64, 4096
#: Documents of each language that training may use, languages that it may learn, characters and pieces of each document.
TRAIN_DOCS, LANGUAGES, TRAIN_CHARS, PIECES = 600, 200, 4000, 8
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Direction:
    """gates: input table (256, 2 STATE) and recurrent (STATE, 2 STATE) of update and reset; the same of the candidate."""

    gates: np.ndarray
    gates_back: np.ndarray
    new: np.ndarray
    new_back: np.ndarray

    def states(self, steps: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(T, B, STATE) for bytes (T, B). Gates are linear between 0 and 1, the candidate between -1 and 1."""
        out = np.zeros((len(steps) + 1, steps.shape[1], STATE), np.float32)
        for t, now in enumerate(steps):
            h = out[t]
            gate = self.gates[now]
            gate += h @ self.gates_back
            np.clip(gate, 0, 1, gate)
            back = h @ self.new_back
            reset = gate[:, STATE:]
            new = self.new[now]
            new += reset * back
            np.clip(new, -1, 1, new)
            h = h - new
            h *= gate[:, :STATE]
            h += new
            out[t + 1] = h
            if keep is not None:
                keep.append((gate, back, new))
        return out[1:]

    def backward(self, steps: np.ndarray, states: np.ndarray, kept: list, grad: np.ndarray) -> list[np.ndarray]:
        """Gradients of the four arrays, by backpropagation through time from those of all states."""
        out = [np.zeros_like(x) for x in (self.gates, self.gates_back, self.new, self.new_back)]
        flow = np.zeros_like(states[0])
        for t in range(len(steps) - 1, -1, -1):
            gate, back, new = kept[t]
            h = states[t - 1] if t else np.zeros_like(flow)
            z, r = gate[:, :STATE], gate[:, STATE:]
            flow = flow + grad[t]
            d_new = flow * (1 - z) * (np.abs(new) < 1)
            d_gate = np.concatenate([flow * (h - new), d_new * back], 1) * ((gate > 0) & (gate < 1))
            d_back = d_new * r
            np.add.at(out[0], steps[t], d_gate)
            out[1] += h.T @ d_gate
            np.add.at(out[2], steps[t], d_new)
            out[3] += h.T @ d_back
            flow = flow * z + d_gate @ self.gates_back.T + d_back @ self.new_back.T
        return out


@dataclass
class Model:
    names: list[str]
    ahead: Direction
    behind: Direction
    output: np.ndarray
    bias: np.ndarray

    def labels(self, steps: np.ndarray) -> np.ndarray:
        """(T, B, languages): the probabilities of every position."""
        hidden = np.concatenate([self.ahead.states(steps), self.behind.states(steps[::-1])[::-1]], 2)
        p = hidden.reshape(-1, 2 * STATE) @ self.output
        p += self.bias
        p -= p.max(1, keepdims=True)
        np.exp(p, p)
        p /= p.sum(1, keepdims=True)
        return p.reshape(*steps.shape, -1)

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """The mean of the probabilities over all bytes of each text, which has one at least."""
        lengths = np.array([len(t) for t in texts])
        pieces = -(-lengths // STEPS)
        flat = np.zeros(int(pieces.sum()) * STEPS, np.uint8)
        starts = np.concatenate([[0], np.cumsum(pieces)[:-1]])
        for t, at in zip(texts, starts, strict=True):
            flat[at * STEPS : at * STEPS + len(t)] = np.frombuffer(t, np.uint8)
        rows = flat.reshape(-1, STEPS)
        left = np.full(len(rows), STEPS)
        left[starts + pieces - 1] = lengths - (pieces - 1) * STEPS
        sums = np.zeros((len(rows), len(self.names)))
        for at in range(0, len(rows), ABREAST):
            p = self.labels(np.ascontiguousarray(rows[at : at + ABREAST].T))
            for b in np.flatnonzero(left[at : at + ABREAST] < STEPS):
                p[left[at + b] :, b] = 0  # padding has no say
            sums[at : at + ABREAST] = p.sum(0)
        return np.add.reduceat(sums, starts) / lengths[:, None]


def train(texts: list[bytes], languages: list[str], epochs: int = 4, seed: int = 11) -> Model:
    """Pieces of the texts, every position labelled with its text's language; Adam on the cross-entropy of all positions."""
    rng = np.random.default_rng(seed)
    names = sorted(set(languages))
    rows, truth = [], []
    for text, lang in zip(texts, languages, strict=True):
        for at in rng.integers(0, max(1, len(text) - STEPS + 1), min(PIECES, 1 + len(text) // STEPS)):
            rows.append(np.frombuffer(text[at : at + STEPS].ljust(STEPS, b"\0"), np.uint8))
            truth.append(names.index(lang))
    x, y = np.array(rows), np.array(truth)
    normal = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    directions = [Direction(normal(256, 2 * STATE) + np.float32(0.5), normal(STATE, 2 * STATE), normal(256, STATE), normal(STATE, STATE)) for _ in range(2)]
    m = Model(names, *directions, normal(2 * STATE, len(names)), np.zeros(len(names), np.float32))
    values = [a for d in directions for a in (d.gates, d.gates_back, d.new, d.new_back)] + [m.output, m.bias]
    first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), 128):
            steps, label = np.ascontiguousarray(x[order[at : at + 128]].T), y[order[at : at + 128]]
            kept: list[list] = [[], []]
            ahead, behind = m.ahead.states(steps, kept[0]), m.behind.states(steps[::-1], kept[1])
            hidden = np.concatenate([ahead, behind[::-1]], 2).reshape(-1, 2 * STATE)
            p = hidden @ m.output + m.bias
            p = np.exp(p - p.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            wrong = p.reshape(*steps.shape, -1)
            wrong[:, np.arange(len(label)), label] -= 1
            wrong = wrong.reshape(len(p), -1) / len(p)
            back = (wrong @ m.output.T).reshape(*steps.shape, -1)
            grads = m.ahead.backward(steps, ahead, kept[0], back[:, :, :STATE]) + m.behind.backward(steps[::-1], behind, kept[1], back[::-1, :, STATE:])
            grads += [hidden.T @ wrong, wrong.sum(0)]
            step += 1
            rate = 0.02 * (1 - epoch / epochs) + 0.001
            for v, g, a, b in zip(values, grads, first, second, strict=True):
                g = np.clip(g, -1, 1)
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                v -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return m


def fit(docs: DataFrame, rows: int = TRAIN_DOCS) -> Model | None:
    """Trains on the driver from at most `rows` documents of each language with text and language outside the held-out fold;
    None without any. Of a text, training sees pieces of a stretch of TRAIN_CHARS; prediction always reads it whole.
    A rare language has all its documents in the sample. More than LANGUAGES languages are refused."""
    stretch = F.substr(F.col("text"), F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - TRAIN_CHARS, F.lit(1))).cast("int") + 1, F.lit(TRAIN_CHARS))
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    if known.select("lang").distinct().limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    sample = bounded_sample(known.select("doc_id", stretch.alias("text"), "lang").filter(F.col("text").rlike(r"\p{L}")), "lang", rows, "language").toPandas()
    sample = sample[np.array([bool(_LETTER.search(t)) for t in sample["text"]], bool)].sort_values(["doc_id", "lang", "text"])
    return train([t.encode() for t in sample["text"]], list(sample["lang"])) if len(sample) else None


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """`docs` with lang_pred and score, from the bytes of the whole text alone.

    Null text, text without a letter (\\p{L}; numbers like a half or a circled one are none), or no model: `und`, score 0. The score is the language's mean probability over
    all positions; ties go to the first name. Rows and other columns stay; columns of those two names are replaced.
    No shuffle; a task runs a bounded number of pieces at a time, whatever the length of a text.
    """
    names = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    out = docs.select(*names)
    schema = out.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, said, scores = batch.column("text").to_pylist(), ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            places = [i for i, t in enumerate(texts) if t and model and _LETTER.search(t)]
            while places:
                part, size = [], 0
                while places and (not part or size < STEPS * ABREAST * 4):
                    part.append(places.pop())
                    size += len(texts[part[-1]])
                p = model.pooled([texts[i].encode() for i in part])
                for i, row in zip(part, p, strict=True):
                    said[i], scores[i] = model.names[int(row.argmax())], min(1.0, row.max())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return mapped(out, run, schema)
