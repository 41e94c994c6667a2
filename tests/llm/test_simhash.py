import random

import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from tidewell.llm import simhash
from tidewell.llm.common import connected_components


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, bits=3):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_against_brute_force(spark, documents, texts):
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = plain_components(fps)
    rows = simhash.near_duplicates(documents).collect()
    assert len(rows) == len(texts)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


def test_hash_is_sparks_own(spark):
    assert simhash.simhash("A  b\tC") == spark.sql("SELECT xxhash64('a b c')").first()[0] % (1 << 64)


def test_links_of_dense_segments_are_as_connected(spark):
    r = random.Random(5)
    base = r.getrandbits(64)
    fps = {base} | {base ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 6))) for _ in range(150)} | {r.getrandbits(64) for _ in range(50)}
    own = {i: f for i, f in enumerate(sorted(fps))}
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in own.items()], "fp long, node long")
    want = plain_components(own)
    for dense in (1000, 1, 3):
        edges = simhash.links(nodes, dense=dense)
        assert all((own[e.a] ^ own[e.b]).bit_count() <= 3 for e in edges.collect())
        got = {x.node: x.component for x in connected_components(edges).collect()}
        assert {i: got.get(i, i) for i in own} == want


def test_every_distance_is_as_connected(spark):
    r = random.Random(6)
    base = [r.getrandbits(64) for _ in range(3)]
    own = dict(enumerate(sorted({b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 9))) for b in base for _ in range(60)})))
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in own.items()], "fp long, node long")
    for bits in (0, 1, 2, 3):
        got = {x.node: x.component for x in connected_components(simhash.links(nodes, max_bits=bits, dense=1)).collect()}
        assert {i: got.get(i, i) for i in own} == plain_components(own, bits)


def test_limit_of_dense_segments_changes_nothing(spark):
    """One segment value with 48 holders and their partners; the limit below, at and above it."""
    r = random.Random(8)
    low = r.getrandbits(32)
    fps = {r.getrandbits(32) << 32 | low for _ in range(40)}
    while len(fps) < 48:
        fps.add((r.choice(sorted(fps)) ^ sum(1 << b for b in r.sample(range(32, 64), r.randint(1, 3)))))
    own = dict(enumerate(sorted(fps)))
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in own.items()], "fp long, node long")
    for dense in (47, 48, 49):
        got = {x.node: x.component for x in connected_components(simhash.links(nodes, dense=dense)).collect()}
        assert {i: got.get(i, i) for i in own} == plain_components(own)


def test_a_hot_group_of_near_copies(spark):
    """20,000 fingerprints around one, and 200 that only a third bit joins: rows stay in proportion."""
    r = random.Random(9)
    base = r.getrandbits(64)
    fps = {base} | {base ^ 1 << i ^ 1 << j for i in range(64) for j in range(i)}
    while len(fps) < 5_200:
        fps.add(base ^ sum(1 << b for b in r.sample(range(64), 3)) if len(fps) < 5_000 else r.getrandbits(32) << 32 | base & 0xFFFFFFFF)
    own = dict(enumerate(sorted(fps)))
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in own.items()], "fp long, node long").repartition(8)
    found = {x.node: x.component for x in connected_components(simhash.links(nodes)).collect()}
    near = [i for i, f in own.items() if (f ^ base).bit_count() <= 3]
    assert len(near) >= 5_000 and {found.get(i, i) for i in near} == {near[0]}
    far = [i for i in own if found.get(i, i) != near[0]]
    for i in far[:20]:  # no member is lost: what stays outside has no neighbour inside
        assert all((own[i] ^ own[j]).bit_count() > 3 for j in own if j != i and found.get(j, j) != found.get(i, i))


def test_long_chains_settle(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in connected_components(edges).collect()} == {0}


def test_edges(edge, nothing):
    rows = simhash.near_duplicates(edge).collect()
    assert len(rows) == edge.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].fingerprint == "0" * 16 and {by[i][0].component_id for i in (1, 2, 3)} == {1}
    assert {x.component_id for x in by[4] + by[5]} == {4} and len(by[5]) == 2
    assert all(x.component_id is None for x in by[None])
    assert simhash.near_duplicates(nothing).count() == 0


def test_near_copy_is_found(spark):
    text = prose(900, 4)
    docs = spark.createDataFrame([(1, text), (2, text.replace("thor", "THOR", 1) + " end"), (3, prose(900, 9))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
