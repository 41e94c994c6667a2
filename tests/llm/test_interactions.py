from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import SCHEMA, row
from tests.oracle import assert_same, connect
from tidewell.llm import interactions, queries

LABELS = "doc_id long, quality int, toxic int, text string, lang string, mask int, part string"


def plain(docs, labels):
    """Every order applied document by document."""
    words = lambda t: [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t) if w]
    low = {}
    for d in docs:
        if d[0] is not None:
            low[d[1] or ""] = min(low.get(d[1] or "", d[0]), d[0])
    good, toxic = ({x[0] for x in labels if x[0] is not None and x[i] == 1} for i in (1, 2))
    parts = {}
    for doc_id, text, lang in docs:
        t = text or ""
        w = words(t)
        fails = {f for f, x in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t), doc_id is not None and doc_id > low[t]), strict=True) if x}
        parts.setdefault(lang or "", []).append((fails, doc_id in good, doc_id in toxic))
    out = {}
    for part, rows in parts.items():
        removed = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = rows
            for s, f in enumerate(order, 1):
                gone, left = [r for r in left if f in r[0]], [r for r in left if f not in r[0]]
                removed[f] += len(gone)
                all_f = sum(f in r[0] for r in rows)
                out[part, "".join(order), s] = (len(left), len(gone), all_f - len(gone), sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone))
        for order in permutations("ABCDE"):
            for s, f in enumerate(order, 1):
                out[part, "".join(order), s] += (removed[f],)
    return out


def got(df):
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(out) == len(rows)
    return out


def test_equals_sql_and_plain(spark, sf_dir, documents):
    df = queries.op11_filter_interactions(spark, sf_dir)
    assert_same(df, connect(sf_dir).sql(queries.ORACLES["op11_filter_interactions"]))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic").collect()
    assert got(df) == plain([tuple(r) for r in documents.select("doc_id", "text", "lang").collect()], [tuple(r) for r in labels])


def test_edges(spark, edge, nothing):
    """Nulls, empty and very long texts, ties, repeated rows and labels, clashing columns, and tables without rows."""
    made = [(1, 1, 0), (1, 1, 0), (5, 1, 1), (5, 0, 0), (None, 1, 1), (9, None, None), (9, 0, 1), (99, 1, 1)]
    labels = spark.createDataFrame([(*x, "t", "xx", 3, "y") for x in made], LABELS)
    docs = [tuple(r) for r in edge.select("doc_id", "text", "lang").collect()]
    assert got(interactions.audit(edge, labels)) == plain(docs, made)
    none = spark.createDataFrame([], LABELS)
    assert got(interactions.audit(edge, none)) == plain(docs, [])
    assert interactions.audit(nothing, labels).count() == 0


def test_a_repeated_id_with_other_texts_and_parts(spark):
    rows = [row(1, "a b", "en"), row(1, "a b", "fr"), row(1, "# c", None), row(2, "a b", ""), row(2, "# c"), row(2, "# c"), row(None, "a b"), row(None, "a b")]
    labels = spark.createDataFrame([(1, 1, 1, "t", "xx", 3, "y")], LABELS)
    assert got(interactions.audit(spark.createDataFrame(rows, SCHEMA), labels)) == plain([(r[0], r[1], r[2]) for r in rows], [(1, 1, 1)])


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6), st.data())
def test_walk_tells_every_set(k, data):
    masks = np.array(data.draw(st.lists(st.integers(0, (1 << k) - 1), unique=True, max_size=1 << k)), dtype=np.int64)
    weights = np.array([[data.draw(st.integers(0, 9)) for _ in range(3)] for _ in masks], dtype=np.int64).reshape(-1, 3)
    states = interactions.walk(masks, weights, k)
    for s in range(1 << k):
        assert states[s].tolist() == weights[(masks & s) == 0].sum(axis=0).tolist()


def test_other_filters(spark):
    docs = spark.createDataFrame([(i, "x" * i, "en") for i in range(6)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int")
    found = got(interactions.audit(docs, labels, {"S": F.length("text") < 2, "L": F.length("text") > 4}, copies="C"))
    assert len(found) == 6 * 3
    assert found["en", "SLC", 1][:4] == (4, 2, 0, 2) and found["en", "LSC", 1][4] == 1
    for filters, copies in (({"E": F.lit(True)}, "E"), ({"AB": F.lit(True)}, "E"), ({x: F.lit(True) for x in "ABCDFGH"}, "E")):
        with pytest.raises(ValueError, match="letter"):
            interactions.audit(docs, labels, filters, copies)
