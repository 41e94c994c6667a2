"""Benchmark decontamination by Wu-Manber search over words.

The patterns are the windows of ``width`` (10) consecutive words of every
benchmark item; an item of fewer words is one window. As in Wu and Manber,
"A fast algorithm for multi-pattern searching" (1994), a table of fixed size
over hashed blocks of two words says how far the search may move on without
missing a pattern, the smallest shift of all blocks of a place; only where it
says 0 is the bucket of that suffix block looked up, and within it the windows
whose first words have the same hash are compared word by word. Patterns of one
length share a table.

Tables are arrays: the words once, and for each window a place and two hashes.
Items are cut, with ``width - 1`` words of overlap, and dealt to shards of at
most about ``shard_words`` words, counted first. Every shard's tables are built
in a task and are about 30 bytes a word; the driver passes on one shard at a
time. More shards mean more passes over the documents, whose hits are united
by row, so the result doesn't depend on ``shard_words``.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import filter_texts, map_columns, materialize

#: Bytes that may stand in a word, A-Z as a-z; all others separate.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: Benchmark words a shard, and words a piece of an item has besides its overlap.
SHARD_WORDS, PIECE = 1 << 20, 1 << 15

digest = xxhash.xxh3_64_intdigest


def words(text: str | None) -> list[bytes]:
    """Lower-cased words of letters, digits and all that is not ASCII."""
    return (text or "").encode().translate(WORD_BYTES).split()


class WuManber:
    """Word windows of one length ``m``, ready for the search.

    ``pieces`` are ``(owner, words)`` with ``m`` words at least; every window of
    each is a pattern.
    """

    def __init__(self, pieces: list[tuple[int, list[bytes]]], m: int):
        self.m, self.block = m, min(2, m)
        self.default = m - self.block + 1
        self.text = b" ".join(w for _, p in pieces for w in p)
        size = np.fromiter((len(w) for _, p in pieces for w in p), dtype=np.int64)
        self.end = (np.cumsum(size + 1) - 1).astype(np.int32 if len(self.text) < 1 << 31 else np.int64)
        self.begin = (self.end - size).astype(self.end.dtype)
        length = np.array([len(p) for _, p in pieces])
        offset = np.r_[0, np.cumsum(length)[:-1]]
        # Hash of the block that ends with each word; 0 where a piece has none before.
        flat = [w for _, p in pieces for w in p]
        block = np.fromiter((digest(w) for w in flat) if self.block == 1 else (digest(a + b" " + b) for a, b in zip([b"", *flat], flat, strict=False)), dtype=np.uint64, count=len(flat))
        del flat
        self.mask = (1 << max(10, int(len(block)).bit_length() + 2)) - 1
        place = (block & np.uint64(self.mask)).astype(np.int64)
        shift = np.full(self.mask + 1, self.default, dtype=np.uint8 if m < 256 else np.int32)
        starts = np.concatenate([np.arange(n - m + 1) + o for n, o in zip(length, offset, strict=True)])
        for end in range(self.block, m + 1):
            np.minimum.at(shift, place[starts + end - 1], np.array(m - end, dtype=shift.dtype))
        self.shift = shift.tobytes() if m < 256 else shift.tolist()
        suffix, prefix = block[starts + m - 1], block[starts + self.block - 1]
        order = np.lexsort((starts, prefix, suffix))
        self.suffix, self.prefix, self.starts = suffix[order], prefix[order], starts[order].astype(np.int32)
        self.offset, self.owner = offset, [o for o, _ in pieces]

    def _block(self, text: list[bytes], end: int) -> int:
        return digest(text[end - 2] + b" " + text[end - 1]) if self.block == 2 else digest(text[end - 1])

    def _bucket(self, text: list[bytes], end: int, key: int) -> list[int]:
        """Owners of the windows that equal the last ``m`` words before ``end``."""
        key, m = np.uint64(key), self.m
        a, z = np.searchsorted(self.suffix, key, "left"), np.searchsorted(self.suffix, key, "right")
        if a == z:
            return []
        first = np.uint64(self._block(text, end - m + self.block))
        a, z = a + np.searchsorted(self.prefix[a:z], first, "left"), a + np.searchsorted(self.prefix[a:z], first, "right")
        if a == z:
            return []
        window = b" ".join(text[end - m : end])
        found = [s for s in self.starts[a:z].tolist() if self.text[self.begin[s] : self.end[s + m - 1]] == window]
        return [self.owner[i] for i in np.unique(np.searchsorted(self.offset, found, "right") - 1).tolist()] if found else []

    def find(self, text: list[bytes]):
        """``(start, owners)`` of each occurrence, from left to right."""
        m, n, shift, mask, block = self.m, len(text), self.shift, self.mask, self._block
        end = m
        while end <= n:
            key = block(text, end)
            step = shift[key & mask]
            if step:
                end += step
                continue
            owners = self._bucket(text, end, key)
            if owners:
                yield end - m, owners
            end += 1


def pattern_tables(pieces: list[tuple[object, list[bytes]]], width: int = 10) -> tuple[list[WuManber], list]:
    """Search tables of pieces of items, one for each window length, and the items that their owners count."""
    names = sorted({k for k, _ in pieces}, key=lambda k: (k is not None, k))
    at = {k: i for i, k in enumerate(names)}
    by: dict[int, list] = {}
    for item, found in pieces:
        if found:
            by.setdefault(min(width, len(found)), []).append((at[item], found))
    return [WuManber(own, m) for m, own in sorted(by.items())], names


def scan(text: list[bytes], tables: list[WuManber]) -> tuple[list[int], set]:
    """Hit words as flat, merged ``[start, end, ...]``, and the owners."""
    spans, items = [], set()
    for table in tables:
        for start, owners in table.find(text):
            spans.append((start, start + table.m))
            items.update(owners)
    flat: list[int] = []
    for a, z in sorted(spans):
        if flat and a <= flat[-1]:
            flat[-1] = max(flat[-1], z)
        else:
            flat += [a, z]
    return flat, items


def shards(benchmark: DataFrame, width: int, shard_words: int) -> DataFrame:
    """``(shard, tables)`` with the pickled tables of each shard, written by the tasks that built them."""

    def cut(ids, texts):
        out: dict[str, list] = {"item_id": [], "n": [], "piece": []}
        for k, text in zip(ids, texts, strict=True):
            found = words(text)
            for a in range(0, max(1, len(found) - width + 1), PIECE):
                part = found[a : a + PIECE + width - 1]
                if part:
                    for name, value in (("item_id", k), ("n", len(part)), ("piece", b" ".join(part))):
                        out[name].append(value)
        return out

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    pieces = materialize(map_columns(items, ["item_id", "text"], "item_id string, n long, piece binary", cut), "decontaminate-pieces")
    n = max(1, -(-(pieces.agg(F.sum("n")).first()[0] or 0) // shard_words))

    def build(pdf):
        import pandas as pd

        own = sorted(zip(pdf["item_id"], (p.split() for p in pdf["piece"]), strict=True), key=lambda x: (x[0] is not None, x[0], x[1]))
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "tables": [pickle.dumps(pattern_tables(own, width))]})

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("item_id", "piece"), F.lit(n)))
    return materialize(dealt.groupBy("shard").applyInPandas(build, "shard long, tables binary"), "decontaminate-tables")


def held_tables(docs: DataFrame, benchmark: DataFrame, width: int, shard_words: int):
    """The broadcast ``(tables, items)`` of each shard, one at a time."""
    built = shards(benchmark, width, shard_words)
    for r in built.select("shard").orderBy("shard").collect():
        raw = built.where(F.col("shard") == r.shard).first().tables
        yield docs.sparkSession.sparkContext.broadcast(bytes(raw))


def load(held, kept: list):
    """The tables of a broadcast, unpickled once a task."""
    if not kept:
        kept.append(pickle.loads(held.value))
    return kept[0]


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)``, one row per input row.

    A null text has no words, a null item no windows; an empty benchmark hits
    nothing, an empty table gives no rows. Every row gets its own row, whatever
    its id and the number of shards: repeated rows come back alike, rows without
    an id keep their hits. Items that repeat a window all count. Items without
    an id take part in the hits but not in the item columns. Very long texts and
    items are searched whole. Other columns of either table aren't read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.monotonically_increasing_id())
    all_held = held_tables(docs, benchmark, width, shard_words)
    first = next(all_held, None)
    second = next(all_held, None)
    if second is not None:  # all passes must see the same numbers
        docs = materialize(docs, "decontaminate-rows")

    def search(held) -> DataFrame:
        kept: list = []

        def run(rows, ids, texts):
            tables, names = load(held, kept) if held else ([], [])
            out = {"row": rows, "doc_id": ids, "n_words": [], "spans": [], "items": []}
            for t in texts:
                found = words(t)
                spans, items = scan(found, tables)
                out["n_words"].append(len(found))
                out["spans"].append(spans)
                out["items"].append(sorted(names[i] for i in items if names[i] is not None))
            return out

        return map_columns(docs, ["row", "doc_id", "text"], "row long, doc_id long, n_words long, spans array<int>, items array<string>", run)

    hits = search(first)
    if second is not None:
        every = materialize(hits, "decontaminate-hits").unionByName(materialize(search(second), "decontaminate-hits"))
        for held in all_held:  # each pass is written before the next shard is fetched
            every = every.unionByName(materialize(search(held), "decontaminate-hits"))
            held.unpersist()
        hits = every.groupBy("row", "doc_id", "n_words").agg(
            F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
        )

    def digests(ids, n_words, spans, items):
        covered = []
        for flat in spans:
            pairs, end, total = sorted(zip(flat[::2], flat[1::2], strict=True)), 0, 0
            for a, z in pairs:
                total += max(0, z - max(a, end))
                end = max(end, z)
            covered.append(total)
        return {
            "doc_id": ids, "n_words": n_words, "n_hit": covered, "n_items": [len(x) for x in items],
            "items_sha256": [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items],
            "contaminated": [n > 0 for n in covered],
        }

    return map_columns(
        hits, ["doc_id", "n_words", "spans", "items"],
        "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean", digests,
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, width: int = 10, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, without any benchmark window; null texts stay.

    Rows are judged one by one, so repeated rows and rows without an id are
    kept or dropped by their text alone, empty and very long ones too, whatever other columns there are. An empty
    benchmark keeps all, an empty table stays empty. What a shard of patterns leaves is written before the next one
    looks at it, so a task holds one shard's tables at a time.
    """
    out, fetched = docs, held_tables(docs, benchmark, width, shard_words)
    held = next(fetched, None)
    while held is not None:

        def clean(held=held):
            tables, _ = load(held, [])
            return lambda text: not any(next(x.find(found), None) for found in [words(text)] for x in tables)

        out, after = filter_texts(out, clean), next(fetched, None)
        if after is not None:
            out = materialize(out, "decontaminate-clean")
            held.unpersist()
        held = after
    return out
