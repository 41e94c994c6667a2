import pyarrow as pa

from tidewell.llm.common import slices


def test_slices_are_bounded_by_rows_and_bytes():
    texts = ["x" * 10, None, "y" * 95, "z" * 300, "", "w" * 60, "v" * 60] + ["u"] * 5
    batch = pa.record_batch({"i": list(range(12)), "text": texts})
    got = list(slices([batch, batch.slice(0, 0)], rows=4, size=100))
    assert [s for part in got for s in part.column(1).to_pylist()] == texts
    for part in got:
        assert 0 < part.num_rows <= 4
        assert part.num_rows == 1 or sum(len(t or "") for t in part.column(1).to_pylist()) <= 100
    assert [len(p) for p in got] == [2, 1, 1, 2, 4, 2]
