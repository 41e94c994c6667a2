import math

import numpy as np
import pytest

from tidewell.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component int, n long, x binary, block binary, rows long"


def rows_of(vectors):
    return [(i, None if v is None else [None if c is None else float(c) for c in v], 0, 1, 2, b"", b"", 3) for i, v in vectors]


def plain(vectors, wanted=16):
    """Whole numbers, exact sums, and the covariance's own eigenvectors."""
    x = {i: [math.floor(64 * np.float64(np.float32(c))) + 1_000_000 for c in v] for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    fit = sorted({tuple(v) for v in x.values()})
    n, dim = len(fit), len(fit[0])
    total = [sum(v[d] for v in fit) for d in range(dim)]
    c = np.array([[float(n * v[d] - total[d]) / n for d in range(dim)] for v in fit])
    e, q = np.linalg.eigh(c.T @ c / n)
    return x, n, total, e[::-1][:wanted], q[:, ::-1][:, :wanted], np.trace(c.T @ c / n)


def compare(df, vectors, near=1e-9):
    x, n, total, e, q, trace = plain(vectors)
    got = {(r.vec_id, r.component): r for r in df.collect()}
    assert set(got) == {(i, k + 1) for i in x for k in range(len(e))} and df.count() == len(got)
    signs = {}
    for (i, k), r in got.items():
        exact = sum((n * v - t) ** 2 for v, t in zip(x[i], total, strict=True))
        assert (r.n, r.deviation) == (n, exact)
        assert r.explained == pytest.approx(e[k - 1] / trace, rel=1e-10) and r.identity_error <= 1e-10
        w = sum((n * v - t) / n * c for v, t, c in zip(x[i], total, q[:, k - 1], strict=True)) / math.sqrt(e[k - 1])
        signs.setdefault(k, math.copysign(1, w * r.whitened) if abs(w) > 0.1 else None)
        if signs[k] is None:
            del signs[k]
        else:
            assert r.whitened == pytest.approx(signs[k] * w, abs=near)


def test_query_against_eigenvectors(spark, sf_dir):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    compare(queries.op13_whitening(spark, sf_dir), vectors)


def test_edges(spark):
    """Null vectors and entries, NaN and infinity, repeated rows and vectors, other lengths, clashing columns, null ids."""
    rng = np.random.default_rng(1)
    base = rng.standard_normal((60, 6)) * [3, 2, 1, 0.8, 0.5, 0.3]
    vectors = [(i, list(v)) for i, v in enumerate(base)]
    odd = [(100, None), (101, [1.0, None, 0, 0, 0, 0]), (102, [math.nan] * 6), (103, [math.inf, 0, 0, 0, 0, 0]), (104, []), (105, [1.0, 2.0])]
    more = [(200, vectors[0][1]), (201, [c + 1e-9 for c in vectors[1][1]])]
    df = whitening.whiten(spark.createDataFrame(rows_of(vectors + odd + more), SCHEMA).repartition(3))
    compare(df, vectors + [o for o in odd if o[0] not in (104, 105)] + more)
    again = whitening.whiten(spark.createDataFrame(rows_of([(1, v) for _, v in vectors] + [(None, vectors[0][1])] * 3), SCHEMA))
    assert again.where("vec_id is null").count() == 18 and again.where("vec_id = 1").count() == 360


def test_nothing_to_say(spark):
    for vectors in ([], [(1, None), (2, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whiten(spark.createDataFrame(rows_of(vectors), SCHEMA)).count() == 0
    flat = [(i, [float(i), 0.0, 2.0 * i]) for i in range(9)]
    assert {r.component for r in whitening.whiten(spark.createDataFrame(rows_of(flat), SCHEMA)).collect()} == {1}


def test_great_entries(spark):
    """Sums stay exact far beyond 32 bits; what no long holds is null."""
    vectors = [(i, [1e10 * i, -3e12 * (i % 3), 0.1 * i]) for i in range(1, 30)]
    x, n, total, *_ = plain(vectors)
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(rows_of(vectors), SCHEMA)).where("component = 1").collect()}
    exact = {i: sum((n * v - t) ** 2 for v, t in zip(x[i], total, strict=True)) for i in x}
    assert got == {i: d if d < 1 << 63 else None for i, d in exact.items()} and None in got.values()
    wild = [(i, [3e38 * (-1) ** i, 1.0 * i]) for i in range(6)]
    assert whitening.whiten(spark.createDataFrame(rows_of(wild), SCHEMA)).where("whitened is null or isnan(whitened)").count() == 0


@pytest.mark.parametrize("values", [1 / np.arange(1, 121.0) ** 2, np.r_[np.full(40, 2.0), np.ones(80)], np.linspace(2, 1, 120), np.r_[np.arange(20, 0, -1.0), np.zeros(100)], np.r_[1e9, np.linspace(2, 1, 119)], np.ones(120)])
def test_components_of_known_spectra(values):
    q = np.linalg.qr(np.random.default_rng(3).standard_normal((120, 120)))[0]
    v, passes = (q * values) @ q.T, []
    e, p = whitening.components(lambda y: passes.append(1) or v @ y, 120, 16)
    assert np.allclose(e, np.sort(values)[::-1][:16], rtol=1e-7, atol=1e-12 * values.max()) and np.abs(p.T @ p - np.eye(16)).max() < 1e-12
    assert np.linalg.norm(v @ p - p * e, axis=0).max() <= 1e-11 * values.max() and len(passes) < 300


def test_filter_is_what_finds_them():
    """With less than half of the space in the block the polynomial has to do the work: many passes, each over the whole data."""
    values = np.linspace(2, 1, 200)
    v, passes = np.diag(values), []
    e, _ = whitening.components(lambda y: passes.append(y.shape) or v @ y, 200, 16)
    assert np.allclose(e, values[:16], rtol=1e-13) and passes.count((200, 40)) > 16
