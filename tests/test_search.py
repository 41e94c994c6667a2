import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import search
from tidewell.operators.documents import CHUNK, schema_guard


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        ("i0", "a", "a.md", 0, "The 100% cat", [1.0, 0.0], ["Red"]), ("i1", "a", "a.md", 1, "a dog", [0.0, 1.0], ["Red"]), ("i2", "b", "b.md", 0, "the cat_dog", [-1.0, 0.0], ["blue"]),
        ("i3", "c", "c.md", 0, "nothing", [0.0, 0.0], []), ("i4", "d", "d.md", 0, "it's the cat's", [1.0, 0.0], None),
    ]
    return spark.createDataFrame(rows, CHUNK)


def run(chunks, query, vector, settings, **more):
    return [(r.doc_id, round(r.score, 6)) for r in search.hybrid_search(chunks, query, vector, settings, **more).collect()]


def test_threshold_is_inclusive_and_ties_are_ordered(chunks):
    assert run(chunks, "cat", [1.0, 0.0], search.Settings(0.9, 0.1, 20, 1.0)) == [("a", 1.0), ("d", 1.0)]


def test_zero_and_opposite_vectors_score_nothing(chunks):
    got = run(chunks, "zzz", [1.0, 0.0], search.Settings(1.0, 0.0, 20, 0.5))
    assert got == [("a", 1.0), ("d", 1.0)]
    assert not any(math.isnan(s) for _, s in run(chunks, "zzz", [0.0, 0.0], search.Settings(1.0, 0.0, 20, 0.0)))


def test_repeated_term_counts_each_time(chunks):
    got = dict(run(chunks, "cat cat dog", [0.0, 1.0], search.Settings(0.0, 1.0, 20, 0.0)))
    assert got["b"] == 1.0 and got["d"] == round(2 / 3, 6)


def test_channel_without_weight_is_left_out(chunks):
    assert dict(run(chunks, "dog", [1.0, 0.0], search.Settings(0.0, 1.0, 20, 0.0))) == {"a": 1.0, "b": 1.0}


def test_blank_query_has_no_keyword_hits(chunks):
    assert run(chunks, "   ", [1.0, 0.0], search.Settings(0.0, 1.0, 20, 0.0)) == []


def test_wildcards_are_live_but_count_literally(chunks):
    got = dict(run(chunks, "c_t", [1.0, 0.0], search.Settings(0.0, 1.0, 20, 0.0)))
    assert set(got) == {"a", "b", "d"} and set(got.values()) == {0.0}


def test_tags_fold_ascii_case_after_the_cut(chunks):
    s = search.Settings(1.0, 0.0, 20, 0.0)
    assert {d for d, _ in run(chunks, "x", [1.0, 0.0], s, tags=["RED"])} == {"a"}
    assert {d for d, _ in run(chunks, "x", [1.0, 0.0], s, tags=["RED"], prefilter=True)} == {"a"}


def test_scores_are_sorted_and_limited(chunks):
    got = run(chunks, "cat", [1.0, 0.5], search.Settings(0.5, 0.5, 2, 0.0))
    assert len(got) == 2 and got == sorted(got, key=lambda x: -x[1])


def test_titles_fall_back_to_names(spark, chunks):
    titles = spark.createDataFrame([("a", ""), ("d", "Title")], "doc_id string, title string")
    rows = search.hybrid_search(chunks, "cat", [1.0, 0.0], search.Settings(1.0, 0.0, 20, 0.9), titles=titles).collect()
    assert {r.doc_id: r.title for r in rows} == {"a": "a.md", "d": "Title"}


def test_nearest_to_each_in_blocks(spark):
    chunks = spark.createDataFrame([(i, 0, [float(i % 5), 1.0]) for i in range(40)], "doc_id long, chunk_index long, embedding array<float>")
    asked = spark.createDataFrame([(q, [float(q), 1.0]) for q in range(5)], "query_id long, vector array<float>")
    one = search.nearest_to_each(asked, chunks, 3).select("query_id", "doc_id").collect()
    two = search.nearest_to_each(asked, chunks, 3, max_queries=2).select("query_id", "doc_id").collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two)) and all(r.doc_id % 5 == r.query_id for r in one)


def test_grid_equals_brute_force(spark):
    """More queries than are sent to all: blocks on a grid, with ties, zero vectors and null ones; each chunk is scanned once."""
    import numpy as np

    rng = np.random.default_rng(4)
    base = rng.integers(-2, 3, (400, 5)).astype(float)
    base[::37] = 0
    v = [(i % 90, i // 90, list(map(float, x)) if i % 50 else None) for i, x in enumerate(base)]
    q = [(i, list(map(float, base[i * 3]))) for i in range(60)]
    chunks = spark.createDataFrame(v, "doc_id long, chunk_index long, embedding array<float>").repartition(3)
    asked = spark.createDataFrame(q, "query_id long, vector array<float>")
    unit = lambda x: np.array(x or [0.0] * 5) / max(np.linalg.norm(x or [0.0] * 5), 1e-300)
    want = {}
    for i, x in q:
        scored = sorted((-round(float(unit(x) @ unit(y)), 12) + 0.0, d, c) for d, c, y in v)[:7]
        want[i] = [(d, c, r + 1) for r, (_, d, c) in enumerate(scored)]
    for options in ({"max_queries": 4096}, {"max_queries": 10, "rows": 16}, {"max_queries": 10, "rows": 1000}, {"max_queries": 0}):
        found = search.nearest_to_each(asked, chunks, 7, **options)
        got = {}
        for r in sorted(found.collect(), key=lambda r: r["rank"]):
            got.setdefault(r.query_id, []).append((r.doc_id, r.chunk_index, r["rank"]))
        assert got == want, options
    none = asked.where("false")
    assert search.nearest_to_each(none, chunks, 3).count() == 0 and search.nearest_to_each(asked, chunks.where("false"), 3, max_queries=1).count() == 0


def test_ties_of_one_common_vector_follow_the_key(spark):
    chunks = spark.createDataFrame([(i, 0, [1.0, 1.0]) for i in range(400)], "doc_id long, chunk_index long, embedding array<float>").repartition(3)
    asked = spark.createDataFrame([(1, [1.0, 1.0]), (2, [0.0, 0.0])], "query_id long, vector array<float>")
    rows = search.nearest_to_each(asked, chunks, 4).select("query_id", "doc_id").collect()
    assert sorted(map(tuple, rows)) == [(q, d) for q in (1, 2) for d in range(4)]


def test_schema_guard(chunks):
    assert not schema_guard(chunks, 2)
    assert schema_guard(chunks, 3)
    assert schema_guard(chunks.drop("tags"), 2)
    assert schema_guard(chunks.withColumn("tags", F.lit("x")), 2)


def test_scores_of_a_block_are_held_in_parts():
    """What a block holds besides its vectors doesn't grow with its rows, and the parts give the hits of the whole."""
    r = np.random.default_rng(3)
    m, q = r.standard_normal((20_000, 8)), r.standard_normal((300, 8))
    at = np.arange(20_000)
    tracemalloc.start()
    hits = search._best(np.arange(300), q, at, at * 0, m, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
    score = np.round(q @ m.T, search.DIGITS)
    want = [np.lexsort((at, -s))[:3] for s in score]
    assert hits["doc_id"].tolist() == np.concatenate(want).tolist()
