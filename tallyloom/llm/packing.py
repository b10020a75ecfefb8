"""Packing of tokenised documents into training sequences by the sum-of-squares rule."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, memory

#: Words, and parts of words, whose ids a Python worker remembers; beyond it the memory of either starts anew.
WORD_MEMORY = 600_000


class _Words:
    """word -> its ids as little-endian uint32 bytes. Words between blanks never merge in this tokenizer, nor do letters
    with the punctuation after them, and the case of ASCII letters does not count: so every new row of letters, and of
    punctuation, is encoded once, many in one text, where the last id of each is a word end. Only rows that have stood
    this test are joined; letters that the tokenizer writes as more than letters, and other words, are encoded whole."""

    MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.forget()
        self.tokenizer = Tokenizer.from_file(path)
        self.written = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else str
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True

    def forget(self, parts: bool = True) -> None:
        self.known: dict[str, bytes] = {"": b""}
        if parts:
            self.parts: dict[str, bytes] = {"": b""}  # rows of letters, or of punctuation, that may be joined

    def alphabetic(self, rows: list[str]) -> list[str]:
        """Those that the tokenizer writes as letters alone; read in one text where it keeps the blanks between them."""
        written = self.written(" ".join(rows)).split(" ")
        if len(written) != len(rows):
            written = [self.written(x) for x in rows]
        return [x for x, y in zip(rows, written, strict=True) if y.isalpha()]

    def learn(self, words: Iterable[str]) -> None:
        made, odd, foreign, known, parts, marks = [], [], [], self.known, self.parts, self.MARKS
        for word in words:
            letters = word.rstrip(marks)
            if not letters.isalpha():
                odd.append(word)
            elif letters.isascii():
                made.append((word, letters.lower(), word[len(letters) :]))
            else:
                foreign.append((word, letters, word[len(letters) :]))
        rows = {x for _, x, _ in made}
        rows.update([x for _, _, x in made])
        if foreign:
            made += foreign
            rows.update([x for _, _, x in foreign], self.alphabetic(list({x for _, x, _ in foreign}.difference(parts))))
        rows = list(rows.difference(parts))
        if rows:
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(rows)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(rows) and stops[-1] == len(ids):
                data, cuts = ids.tobytes(), [0, *(4 * stops).tolist()]
                parts.update(zip(rows, [data[x:y] for x, y in zip(cuts, cuts[1:], strict=False)], strict=True))
        for word, letters, end in made:
            if letters in parts and end in parts:
                known[word] = parts[letters] + parts[end]
            else:
                odd.append(word)
        for word, found in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False) if odd else [], strict=True):
            known[word] = np.asarray(found.ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        words = text.replace("\n", " ").split(" ")
        new = set(words).difference(self.known)
        if new:
            if len(self.known) > WORD_MEMORY:
                self.forget(len(self.parts) > WORD_MEMORY)
                new = set(words) - {""}
            self.learn(new)
        return b"".join(map(self.known.__getitem__, words))


def _encoder(path: str):
    return memory(("packing", path), lambda: _Words(path)).encode


def _split(piece: tuple, room: int) -> tuple[tuple, tuple | None]:
    """The first ids of a piece, as many as there is room for, and what is left of it."""
    document, start, length, ids, *more = piece
    if length <= room:
        return piece, None
    return (document, start, room, ids[: 4 * room], *more), (document, start + room, length - room, ids[4 * room :], *more)


class Levels:
    """Open windows by fill level; `count[h]` windows hold h ids. A piece goes where the sum of squared counts ends smallest."""

    def __init__(self, size: int):
        self.size, self.count, self.open = size, np.zeros(size + 1, np.int64), {}

    def place(self, piece: tuple, length: int) -> list | None:
        """Returns the window that the piece has filled, if it has."""
        n, size = self.count, self.size
        change = 2 * (n[length:] - n[: size + 1 - length]) + 2  # of the sum, for each level that has room
        change[-1] = 1 - 2 * n[size - length]  # a full window is not open any more
        change[n[: size + 1 - length] == 0] = np.iinfo(np.int64).max
        change[0] = 2 * n[length] + 1  # a new window
        level = len(change) - 1 - int(np.argmin(change[::-1]))  # ties: the fullest
        window = []
        if level:
            window = self.open[level].pop()
            n[level] -= 1
        window.append(piece)
        if level + length == size:
            return window
        self.open.setdefault(level + length, []).append(window)
        n[level + length] += 1
        return None

    def rest(self) -> Iterator[list]:
        """Ends the packing: the emptiest windows fill the fullest, cut where needed; the last one is cut at powers of two."""
        windows = [w for h in sorted(self.open, reverse=True) for w in self.open[h]]
        pieces = deque(p for w in reversed(windows) for p in w)  # the emptiest come first
        fullest, taken, total = 0, 0, sum(p[2] for p in pieces)
        while total >= self.size:
            window = windows[fullest]
            fill = sum(p[2] for p in window)
            for _ in range(len(window)):  # its own pieces are the last
                pieces.pop()
            total -= fill
            fullest += 1
            gap = self.size - fill
            while gap:
                piece, rest = _split(pieces.popleft(), gap)
                window.append(piece)
                gap, total = gap - piece[2], total - piece[2]
                if rest:
                    pieces.appendleft(rest)
            yield window
        part, room = [], 0
        while pieces:
            if not room:
                room = 1 << (total.bit_length() - 1)
            piece, rest = _split(pieces.popleft(), room)
            part.append(piece)
            room, total = room - piece[2], total - piece[2]
            if rest:
                pieces.appendleft(rest)
            if not room:
                yield part
                part = []


def pack(docs: DataFrame, tokenizer_path: str, size: int = 4096, end_id: int = 2) -> DataFrame:
    """One row for each piece of a document: doc_id, start, length, doc_tokens, sequence_id, offset and ids, as little-endian
    uint32 bytes. Every id of a document, with `end_id` after the last, lies in one piece.

    Each task packs its own input partition online and holds its open windows only; no shuffle. Documents longer than a
    window give full windows and a rest. At the end of a task the open windows are emptied into one another, and what
    is left of the last is cut at powers of two, so that nothing is padded. A window holds its own ids only, so beside the
    ids of the text at hand, however long, a task's memory is that of its open windows.
    Null or empty text: the end id alone. A null or repeated doc_id is packed as it is. Other columns are not read.
    An empty table gives no rows. Rows of a partition are packed in the order in which they come.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, levels, out = _encoder(tokenizer_path), Levels(size), []
        base, done = TaskContext.get().partitionId() << 32, 0
        end = np.asarray([end_id], "<u4").tobytes()

        def close(window: list) -> None:
            nonlocal done
            offset = 0
            for doc_id, start, length, ids, total in window:
                out.append((doc_id, start, length, total, base + done, offset, ids))
                offset += length
            done += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            out.clear()
            names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for c, n in zip(columns, names, strict=True)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                total = len(ids) // 4
                for start in range(0, total, size):
                    length = min(size, total - start)
                    piece = (doc_id, start, length, ids[4 * start : 4 * (start + length)], total)
                    if length == size:
                        close([piece])
                    elif full := levels.place(piece, length):
                        close(full)
            yield flush()
        for window in levels.rest():
            close(window)
        yield flush()

    schema = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema)


def digested(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
