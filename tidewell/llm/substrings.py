"""Substring deduplication on a compacted de Bruijn graph of words.

The graph is sparse: of the ``k``-word runs of the corpus it has those that some
window of ``window`` (50) words picks as its smallest by hash, its minimizer (the
leftmost of equals); equal windows pick equal ones (minimum substring
partitioning: Li, Kamousi, Han, Yang, Yan, Suri, 2013; sparse graphs: Ye, Ma,
Cannon, Pop, Yu, 2012). A node is the text of the consecutive windows that share
a minimizer, kept as a digest of its words with its source coordinates; an edge
leads to the node that follows in a document. Then, all by joins:

1. minimizers that only one document has are left out;
2. each node gets its first source, the smallest document that has it;
3. nodes with one edge out, whose successor has one edge in and the same first
   source, don't branch. Such paths are compacted by pointer doubling: every
   node learns the head of its path, its rank and its distance in words;
4. every other document loses the words of the paths that it shares, one span
   for each stretch of a path. Digests at the source coordinates, 128 bits of the
   words themselves, say that they are the same;
5. where a minimizer has several nodes, that is where the graph branches within
   a run, the windows of each node's first source are compared one by one.

A record holds at most ``window - k + 1`` windows, so what is exchanged grows
with the text, never with the square of a group of copies.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import map_columns, materialize

#: What tells one row of the table from another.
ROW = ("doc_id", "tie")
#: Odd factor of the rolling hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Runs:
    """Hashes of all ``k``-word runs of a text; powers are kept between texts."""

    def __init__(self, k: int):
        self.k = k
        self.up, self.down = _powers(BASE, 1 << 12), _powers(INVERSE, 1 << 12)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        n, k = len(words), self.k
        if n > len(self.up):
            size = 1 << n.bit_length()
            self.up, self.down = _powers(BASE, size), _powers(INVERSE, size)
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=n)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(h * self.up[:n], out=total[1:])
        x = (total[k:] - total[:-k]) * self.down[: n - k + 1]
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        return x ^ (x >> np.uint64(32))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each ``w`` neighbours, in log(w) steps."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out, have = np.minimum(out[:-step], out[step:]), have + step
    return out


def compact(hashes: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer, first window and number of windows of each path of a text."""
    # The upper half of the hash, then the place: the same order in a text of any length.
    place = np.arange(len(hashes), dtype=np.uint64)
    least = sliding_min((hashes >> np.uint64(32) << np.uint64(32)) | place, w)
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return hashes[at[first]].view(np.int64), first, np.diff(np.append(first, len(at)))


def _spans(words: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by spaces, and where each begins and ends."""
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(size + 1) - 1
    return b" ".join(words), end - size, end


def paths(docs: DataFrame, window: int, k: int) -> DataFrame:
    """``(doc_id, tie, minimizer, h1, h2, start, n)`` of every compacted path."""

    def run(ids, ties, texts):
        runs = Runs(k)
        out: dict[str, list] = {c: [] for c in ("doc_id", "tie", "minimizer", "h1", "h2", "start", "n")}
        for doc, tie, text in zip(ids, ties, texts, strict=True):
            words = (text or "").encode().split()
            if len(words) < window:
                continue
            least, first, n = compact(runs(words), window - k + 1)
            joined, begin, end = _spans(words)
            cut = zip(begin[first].tolist(), end[first + n + (window - 2)].tolist(), strict=True)
            halves = np.frombuffer(b"".join(xxhash.xxh3_128_digest(joined[a:z]) for a, z in cut), dtype="<i8").reshape(-1, 2)
            out["doc_id"] += [doc] * len(first)
            out["tie"] += [tie] * len(first)
            for name, values in (("minimizer", least), ("h1", halves[:, 0]), ("h2", halves[:, 1]), ("start", first), ("n", n)):
                out[name].append(values)
        return {c: v if c in ROW else np.concatenate(v) if v else [] for c, v in out.items()}

    return map_columns(docs, ["doc_id", "tie", "text"], "doc_id long, tie long, minimizer long, h1 long, h2 long, start int, n int", run)


def windows(listed: DataFrame, window: int) -> DataFrame:
    """``(doc_id, tie, start, w1, w2)`` of each window of the listed paths."""

    def run(ids, ties, texts, parts):
        out: dict[str, list] = {c: [np.empty(0, dtype=np.int64)] for c in ("doc_id", "tie", "start", "w1", "w2")}
        for doc, tie, text, own in zip(ids, ties, texts, parts, strict=True):
            joined, begin, end = _spans((text or "").encode().split())
            at = np.concatenate([np.arange(p["start"], p["start"] + p["n"]) for p in own])
            cut = zip(begin[at].tolist(), end[at + window - 1].tolist(), strict=True)
            halves = np.frombuffer(b"".join(xxhash.xxh3_128_digest(joined[a:z]) for a, z in cut), dtype="<i8").reshape(-1, 2)
            for name, values in zip(out, (np.full(len(at), doc), np.full(len(at), tie), at, halves[:, 0], halves[:, 1]), strict=True):
                out[name].append(values)
        return {c: np.concatenate(v) for c, v in out.items()}

    return map_columns(listed, ["doc_id", "tie", "text", "parts"], "doc_id long, tie long, start int, w1 long, w2 long", run)


def compacted(placed: DataFrame, max_rounds: int = 40, row: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``(node, head, rank, words)`` of the nodes that follow another on a nonbranching path.

    ``placed`` (doc_id, h1, h2, start, n, first); ``row`` are the columns that tell rows apart. A node that no other must
    precede is the head of its own path and isn't listed; nor are those of a
    path that runs in a circle.
    """
    node = F.struct("h1", "h2")
    here = placed.select(*row, (F.col("start") + F.col("n")).alias("start"), node.alias("u"), F.col("first").alias("fu"), "n")
    there = placed.select(*row, "start", node.alias("v"), F.col("first").alias("fv"))
    edges = materialize(here.join(there, [*row, "start"]).drop(*row, "start").distinct(), "substrings-edges")
    out = edges.groupBy("u").agg(F.count("*").alias("d"), *(F.min(c).alias(c) for c in ("v", "fu", "fv", "n"))).where("d = 1 AND fu = fv AND u <> v")
    one_in = edges.groupBy("v").agg(F.count("*").alias("d")).where("d = 1").select("v")
    pointers = out.join(one_in, "v", "left_semi").select(F.col("v").alias("node"), F.col("u").alias("to"), F.lit(1).alias("rank"), F.col("n").cast("long").alias("words"))
    seen = None
    for i in range(max_rounds):
        pointers = materialize(pointers, f"substrings-pointers-{i}")
        more = pointers.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("rank").alias("rank2"), F.col("words").alias("words2"))
        open_ = pointers.join(more, "to", "left_semi").count()
        if open_ in (0, seen):  # what is left open runs in circles
            heads = pointers.join(more, "to", "left_anti")
            return heads.select("node", F.col("to").alias("head"), "rank", "words")
        seen = open_
        pointers = pointers.join(more, "to", "left").select(
            "node", F.coalesce("to2", "to").alias("to"), (F.col("rank") + F.coalesce("rank2", F.lit(0))).alias("rank"), (F.col("words") + F.coalesce("words2", F.lit(0))).alias("words")
        )
    raise RuntimeError(f"paths did not end in {max_rounds} doublings")


def path_spans(placed: DataFrame, window: int, row: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``(*row, start, stop)``: the stretches of compacted paths that a smaller document has, too."""
    stop = F.col("start") + F.col("n") + (window - 1)
    own = placed.where("doc_id > first").select(*row, F.struct("h1", "h2").alias("node"), "start", stop.alias("stop"))
    on = own.join(compacted(placed, row=row), "node", "left")
    head, rank = F.coalesce("head", "node").alias("head"), F.coalesce("rank", F.lit(0)).alias("rank")
    lined = on.select(*row, head, rank, "start", "stop", (F.col("start") - F.coalesce("words", F.lit(0))).alias("line"))
    # On one line a path's nodes lie side by side, if none is left out between them.
    each = lined.groupBy(*row, "head", "line").agg(
        F.collect_set(F.struct("start", "stop")).alias("all"), (F.max("rank") - F.min("rank") + 1).alias("n"), F.min("start").alias("start"), F.max("stop").alias("stop")
    )
    whole = F.when(F.size("all") == F.col("n"), F.array(F.struct("start", "stop"))).otherwise(F.col("all"))
    return each.select(*row, F.explode(whole).alias("x")).select(*row, "x.start", "x.stop")


def repeated_spans(docs: DataFrame, window: int = 50, k: int = 16) -> DataFrame:
    """Words ``[start, stop)`` to remove from rows ``(doc_id, tie, text)``: ``(doc_id, tie, start, stop)``; spans overlap."""
    every = materialize(paths(docs, window, k), "substrings-paths")
    # Written, so that the joins read plain exchanges, of which Spark splits hot keys.
    shared = materialize(every.groupBy("minimizer").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("minimizer"), "substrings-minimizers")
    kept = materialize(every.join(shared, "minimizer", "left_semi"), "substrings-shared")
    firsts = materialize(kept.groupBy("minimizer", "h1", "h2").agg(F.min("doc_id").alias("first")), "substrings-firsts")
    placed = materialize(kept.join(firsts, ["minimizer", "h1", "h2"]), "substrings-placed")
    same = path_spans(placed, window, ROW)

    branching = materialize(firsts.groupBy("minimizer").agg(F.min("first").alias("lo"), F.max("first").alias("hi")).where("lo < hi").select("minimizer"), "substrings-branching")
    parts = (
        placed.where("doc_id = first").join(branching, "minimizer", "left_semi")
        .groupBy(*ROW).agg(F.collect_set(F.struct("start", "n")).alias("parts"))
    )
    single = materialize(windows(docs.join(parts, list(ROW)), window), "substrings-windows")
    earliest = single.groupBy("w1", "w2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    alone = single.join(earliest, ["w1", "w2"]).where("doc_id > lo").select(*ROW, "start", (F.col("start") + window).alias("stop"))
    return same.unionByName(alone)


def remove_repeats(docs: DataFrame, window: int = 50, k: int = 16, with_text: bool = True) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256[, kept_text])`` by input row.

    A null text has no words, a very long one is taken whole. Rows that share a doc_id,
    with one text or several, are rows of one document: they don't count against each other, and each is judged
    by its own words. A row without an id is compared with none and keeps its words. Other columns aren't read.
    An empty table gives no rows.
    """
    # A row is told by its id and its text's hash; only the id says which document is the smaller one.
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    spans = repeated_spans(docs.where("doc_id is not null"), window, k)
    lists = spans.groupBy(*ROW).agg(F.collect_set(F.struct("start", "stop")).alias("spans"))

    def run(ids, texts, found):
        out: dict[str, list] = {c: [] for c in ("n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text)}
        for text, own in zip(texts, found, strict=True):
            words = (text or "").encode().split()
            n = len(words)
            if own:
                gone = np.zeros(n + 1, dtype=np.int32)
                for x in own:
                    gone[x["start"]] += 1
                    gone[x["stop"]] -= 1
                keep = np.cumsum(gone)[:n] == 0
                words = [words[i] for i in np.flatnonzero(keep).tolist()]
            left = b" ".join(words)
            for name, value in zip(out, (n, n - len(words), hashlib.sha256(left).hexdigest(), left.decode() if with_text else None), strict=False):
                out[name].append(value)
        return {"doc_id": ids} | out

    return map_columns(
        docs.join(lists, list(ROW), "left"), ["doc_id", "text", "spans"],
        "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text, run,
    )
