"""SimHash near-duplicates by multi-index hashing.

Fingerprints of 64 bits link at ``max_bits`` (3) or fewer differing bits. Two
segments of 32 bits: a pair at distance 3 or less differs by at most one bit
in one of them, so it meets when the one fingerprint looks up its segment and
the other its segment with one bit flipped (Norouzi, Punjani, Fleet, "Fast
search in Hamming space with multi-index hashing", 2012). Only the flips from
0 to 1 are enumerated, as the partner has the 1; the whole distance is then
verified.

A segment value that more than ``dense`` fingerprints hold is not joined row by
row. Its members are linked over midpoints: all fingerprints within one bit of
any 64-bit value are within two bits of each other, so a star joins them, and
whoever is two bits from that value is within three of them all. Only members
outside the largest part of their segment value look for the third bit. So a
member has a fixed number of rows, 65 or 2081, however many share its segment,
and every step is a join or a grouping of Spark. ``dense`` changes the work,
not the components.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import connected_components, map_columns, materialize

#: A-Z to a-z, all other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def simhash(text: str | None, width: int = 3) -> int:
    """Unsigned fingerprint of one text; 0 without words (null: none)."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return _majority(np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=np.uint64))
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(size + 1) - 1
    first, last = (end - size)[: 1 - width].tolist(), end[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return _majority(np.array([digest(joined[a:z], 42) for a, z in zip(first, last, strict=True)], dtype=np.uint64))


def _majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    count = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        raw = hashes[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * count > len(hashes)).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``; ``fp`` is the fingerprint as a signed long."""

    def run(ids, texts):
        found = [simhash(t) for t in texts]
        return {"doc_id": ids, "fp": [v - (1 << 64) if v >> 63 else v for v in found]}

    return map_columns(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), ["doc_id", "text"], "doc_id long, fp long", run)


def links(nodes: DataFrame, max_bits: int = 3, dense: int = 256) -> DataFrame:
    """Links ``(a, b)`` between nodes ``(fp, node)`` of distinct fingerprints.

    Complete up to connectivity: pairs in sparse segment values are all there,
    those in dense ones are there or joined by a path of links, for any ``dense``.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments with one flipped bit find up to 3 differing bits")
    half = (F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32))
    table = materialize(
        nodes.select("fp", "node", F.posexplode(F.array(*half)).alias("seg", "key")), "simhash-segments"
    )
    bits = F.array(*(F.lit(1 << i).cast("long") for i in range(32)))
    flips = table.select("fp", "node", "seg", F.explode(F.transform(F.filter(bits, lambda b: F.col("key").bitwiseAND(b) == 0), lambda b: F.col("key").bitwiseOR(b))).alias("key"))
    hot = materialize(table.groupBy("seg", "key").agg(F.count("*").alias("n")).where(F.col("n") > dense).select("seg", "key"), "simhash-hot")
    probes = table.withColumn("own", F.lit(True)).unionByName(flips.withColumn("own", F.lit(False)))

    # Only segment values that hold something are worth a lookup.
    t, p = table.join(hot, ["seg", "key"], "left_anti").alias("t"), probes.alias("p")
    near = F.bit_count(F.col("t.fp").bitwiseXOR(F.col("p.fp"))) <= max_bits
    sparse = t.join(
        p, (F.col("t.seg") == F.col("p.seg")) & (F.col("t.key") == F.col("p.key")) & near & ((~F.col("p.own") & (F.col("t.fp") != F.col("p.fp"))) | (F.col("t.fp") > F.col("p.fp")))
    ).select(F.col("t.node").alias("a"), F.col("p.node").alias("b"))
    if hot.isEmpty():
        return sparse
    members = materialize(probes.join(hot, ["seg", "key"]).select("seg", "key", "fp", "node"), "simhash-members")
    return sparse.unionByName(dense_links(members, max_bits))


def ring(nodes: DataFrame, bits: int) -> DataFrame:
    """``(z, node)``: each 64-bit value that differs from a node's ``fp`` in ``bits`` bits."""
    out = nodes.select(F.col("fp").alias("z"), "node", F.lit(0).alias("low"))
    for _ in range(bits):
        out = out.where("low < 64").select("z", "node", F.explode(F.sequence("low", F.lit(63))).alias("bit"))
        out = out.select(F.expr("z ^ shiftleft(1L, bit)").alias("z"), "node", (F.col("bit") + 1).alias("low"))
    return out.select("z", "node")


def dense_links(members: DataFrame, max_bits: int) -> DataFrame:
    """Links ``(a, b)`` that connect all members ``(seg, key, fp, node)`` within ``max_bits`` bits of each other.

    Every link is within ``max_bits`` bits; a group of one midpoint has at most 65 nodes.
    """
    half, odd = divmod(max_bits, 2)
    nodes = materialize(members.select("fp", "node").distinct(), "simhash-dense")
    ball = reduce(DataFrame.unionByName, (ring(nodes, i) for i in range(half + 1)))
    stars = ball.groupBy("z").agg(F.min("node").alias("a"), F.collect_list("node").alias("all")).where(F.size("all") > 1)
    out = materialize(stars.select("a", F.explode("all").alias("b")).where("a <> b").distinct(), "simhash-stars")
    if not odd:
        return out
    close = connected_components(out, "simhash-close")
    placed = materialize(members.join(close, "node", "left").withColumn("component", F.coalesce("component", "node")), "simhash-placed")
    parts = placed.groupBy("seg", "key", "component").agg(F.count("*").alias("n"))
    main = parts.groupBy("seg", "key").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    outside = placed.join(main, ["seg", "key"]).where("component <> main").select("fp", "node").distinct()
    outside = materialize(outside, "simhash-outside")
    first = ball.groupBy("z").agg(F.min("node").alias("a"))
    # Both sides hold many times the rows of the files they are read from, so neither may be broadcast on those files' size.
    more = ring(outside, half + 1).hint("merge").join(first, "z").where("a <> node").select("a", F.col("node").alias("b")).distinct()
    return out.unionByName(more)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per input row.

    A null text has no words; texts without words share the fingerprint 0 and
    link like any other. A repeated row comes back as often as it came. A row
    without an id keeps a null id and joins no group that has one. Very long
    texts are hashed whole, in pieces of 8192 shingles. Ties in a bit's majority
    leave it 0. Other columns of ``docs`` aren't read. An empty table gives no rows.
    """
    marked = materialize(fingerprints(docs, id_col, text_col), "simhash-fp")
    nodes = materialize(marked.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-nodes")
    parts = connected_components(links(nodes), "simhash-cc")
    groups = nodes.join(parts, "node", "left").select(F.col("fp").alias("g_fp"), F.coalesce("component", "node").alias("component_id"))
    return marked.join(groups, (F.col("fp") == F.col("g_fp")) & F.col("doc_id").isNotNull(), "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )

