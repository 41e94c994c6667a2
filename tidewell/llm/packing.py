"""Pattern packing of documents into token sequences.

The histogram of piece lengths has at most ``size`` (4096) bins whatever the
corpus. Patterns of two to four lengths that fill a sequence are enumerated,
their repeat counts are fitted to the histogram by non-negative least squares
(accelerated projected gradient), rounded down, and what is left is packed by
best fit, decreasing, again as patterns with repeat counts (see Krell, Kosec,
Perez, Fitzgibbon, "Efficient Sequence Packing without Cross-contamination",
2021). The plan therefore has a bounded number of rows: at most ``PER_LENGTH``
patterns a length, and each best-fit pattern uses up a bin. Pieces find their
places by their rank among the pieces of their length; ranks are counted in
``salts`` groups a length, so that a length that a third of all documents
share is not numbered in one task.
"""

from __future__ import annotations

import functools
import json
import zlib
from array import array

import numpy as np
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewell.llm.common import map_columns, materialize
from tidewell.llm.tokens import byte_alphabet

#: Patterns enumerated for each length as their longest.
PER_LENGTH = 12


class WordEncoder(dict):
    """Ids of a lower-casing word BPE by white-space word, as little-endian bytes.

    The tokenizer drops white space and never merges across it, so a text's
    ids are those of its words. In the ranks a word's end is the byte 0xFF,
    which no UTF-8 text has: the ids of a last byte with its end are below
    those of all merges, so this first merge is always the one taken.
    """

    def __init__(self, path: str, most: int = 300_000):
        super().__init__()
        self.most = most
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [x["content"] for x in spec["added_tokens"]]
        of, ranks = byte_alphabet(), {}
        for token, i in spec["model"]["vocab"].items():
            if token not in self.added:
                body, end = (token[:-4], b"\xff") if token.endswith("</w>") else (token, b"")
                ranks[bytes(of[c] for c in body) + end] = i
        pattern = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")["pattern"]["Regex"]
        self.pieces = regex.compile(pattern).findall
        self.bpe = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        low = word.lower()
        if low.isalpha():
            ids = self.bpe(low.encode() + b"\xff")
        elif "<" in word and any(x in word for x in self.added):
            ids = self.library.encode(word, add_special_tokens=False).ids
        else:
            ids = [i for piece in self.pieces(low) for i in self.bpe(piece.encode() + b"\xff")]
        found = self[word] = array("I", ids).tobytes()
        return found

    def ids(self, text: str) -> bytes:
        """All ids of a text. Beyond U+024F, where normalisation may change
        characters, and for separators of ASCII, the library encodes it whole."""
        plain = text.isascii() or (max(text) < "ɐ" and "İ" not in text)
        if plain and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return b"".join(map(self.__getitem__, text.split()))
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces(docs: DataFrame, path: str, size: int = 4096, end_id: int = 1) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of every document."""

    def run(ids, texts):
        encode = word_encoder(path).ids
        tail = np.array([end_id], dtype="<u4").tobytes()
        out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for doc, text in zip(ids, texts, strict=True):
            raw = encode(text or "") + tail
            for k, at in enumerate(range(0, len(raw), 4 * size)):
                part = raw[at : at + 4 * size]
                for name, value in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                    out[name].append(value)
        return out

    return map_columns(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id", "text"],
        "doc_id long, piece int, start long, length long, ids_crc32 long", run,
    )


def patterns(count: np.ndarray, size: int) -> list[tuple[int, ...]]:
    """Fillings of two to four lengths, each longest first; ``count`` by length."""
    out: set[tuple[int, ...]] = set()
    there = count > 0
    lengths = np.flatnonzero(there)
    for top in lengths[::-1].tolist():
        rest = size - top
        if rest <= 0:
            continue
        if rest <= top and there[rest]:
            out.add((top, rest))
        a = lengths[(lengths <= min(top, rest - 1)) & (2 * lengths >= rest)]
        a = a[there[rest - a]] if len(a) else a
        for x in a[np.argsort(-np.minimum(count[a], count[rest - a]), kind="stable")[: PER_LENGTH // 2]].tolist():
            out.add((top, x, rest - x))
        usual = lengths[(lengths <= top) & (lengths < rest)]
        for mid in usual[np.argsort(-count[usual], kind="stable")[: PER_LENGTH // 4]].tolist():
            left = rest - mid
            b = lengths[(lengths <= mid) & (lengths < left) & (2 * lengths >= left)]
            b = b[there[left - b]] if len(b) else b
            for x in b[np.argsort(-np.minimum(count[b], count[left - b]), kind="stable")[:1]].tolist():
                out.add((top, mid, x, left - x))
    return sorted(out, reverse=True)


def fit(found: list[tuple[int, ...]], count: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts ``x >= 0`` that make the patterns' lengths closest to ``count``."""
    row = np.array([x for p in found for x in p], dtype=np.int64)
    col = np.repeat(np.arange(len(found)), [len(p) for p in found])
    n, m = len(count), len(found)
    lengths = lambda x: np.bincount(row, x[col], minlength=n)
    back = lambda r: np.bincount(col, r[row], minlength=m)
    v = np.ones(m)
    for _ in range(20):
        v = back(lengths(v))
        norm = np.linalg.norm(v)
        v /= norm
    step, target = 1 / (1.05 * norm), count.astype(float)
    x = y = np.zeros(m)
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(lengths(y) - target))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def plan(histogram: dict[int, int], size: int = 4096) -> np.ndarray:
    """Rows ``(length, first rank, end rank, repeats, sequence, offset)``.

    Of a pattern with ``n`` repeats that holds a length ``k`` times, the ranks
    ``r`` from the first on go to sequence ``s + r % n`` at ``o + r // n * length``.
    """
    left = np.zeros(size + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    taken, rows, sequence = np.zeros(size + 1, dtype=np.int64), [], 0

    def put(pattern: dict[int, int], n: int) -> None:
        nonlocal sequence
        offset = 0
        for length, k in pattern.items():
            rows.append((length, taken[length], taken[length] + n * k, n, sequence, offset))
            taken[length] += n * k
            left[length] -= n * k
            offset += k * length
        sequence += n

    found = patterns(left, size)
    if found:
        x = fit(found, left)
        for i in np.argsort(-x, kind="stable").tolist():
            held: dict[int, int] = {}
            for length in found[i]:
                held[length] = held.get(length, 0) + 1
            n = min(int(x[i]), *(int(left[length]) // k for length, k in held.items()))
            if n > 0:
                put(held, n)
    while left.any():  # best fit, decreasing, all repeats of a filling at once
        room, held, open_ = size, {}, np.flatnonzero(left)
        while len(open_ := open_[open_ <= room]):
            length = int(open_[-1])
            k = min(room // length, int(left[length]))
            held[length], room, open_ = k, room - k * length, open_[:-1]
        put(held, min(int(left[length]) // k for length, k in held.items()))
    rows.sort()
    return np.array(rows, dtype=np.int64).reshape(-1, 6)


def pack(docs: DataFrame, path: str, size: int = 4096, end_id: int = 1, salts: int = 64, group: int = 1 << 16) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``.

    A null or empty text is the end id alone, a very long one is cut whole.
    Repeated rows and rows without an id are packed as often as they came;
    pieces that tie in id and number are ordered by their digest, and equal ones
    may change places. Other columns aren't read. An empty table gives no rows.
    Each length is ranked in ``salts`` groups, more where more than ``group``
    pieces would share one.
    """
    cut = materialize(pieces(docs, path, size, end_id), "packing-pieces")
    histogram = {r.length: r["count"] for r in cut.groupBy("length").count().collect()}
    salts = max(salts, -(-max(histogram.values(), default=0) // group))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = sizes.select(
        "length", "salt",
        (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"),
    )
    rows = plan(histogram, size)
    most = int(rows[:, 2].max()) + 1 if len(rows) else 1
    starts = rows[:, 0] * most + rows[:, 1]

    def place(doc, piece, start, length, crc, rank):
        length_, rank_ = np.array(length, dtype=np.int64), np.array(rank, dtype=np.int64)
        at = np.searchsorted(starts, length_ * most + rank_, side="right") - 1
        copy, nth = np.divmod(rank_ - rows[at, 1], rows[at, 3])
        return {"doc_id": doc, "piece": piece, "start": start, "length": length, "ids_crc32": crc, "sequence_id": rows[at, 4] + nth, "offset": rows[at, 5] + copy * length_}

    ranked = salted.join(before, ["length", "salt"]).withColumn(
        "rank", F.col("before") + F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    )
    return map_columns(
        ranked, ["doc_id", "piece", "start", "length", "ids_crc32", "rank"],
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long", place,
    )
