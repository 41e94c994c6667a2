import hashlib
import random
import re

from tests.llm.conftest import prose
from tidewell.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items):
    windows = {}
    for k, text in items:
        w = plain_words(text)
        m = min(10, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[i : i + m]), set()).add(str(k))
    out = {}
    for d, text in docs.items():
        w, hit, found = plain_words(text), set(), set()
        for m in {len(x) for x in windows}:
            for i in range(len(w) - m + 1):
                if (own := windows.get(tuple(w[i : i + m]))) is not None:
                    hit |= set(range(i, i + m))
                    found |= own
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def values(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


def test_against_brute_force(spark, sf_dir, documents, texts):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = plain(texts, [(r.item_id, r.text) for r in bench.collect()])
    assert values(dc.decontaminate(documents, bench)) == want
    assert sum(w[4] for w in want.values()) > 0
    assert values(dc.decontaminate(documents, bench, shard_words=1000)) == want


def test_short_repeated_and_overlapping_items(spark):
    r = random.Random(3)
    some = lambda n: " ".join(r.choice("abc") for _ in range(n))
    items = [(i, some(r.choice([1, 2, 3, 9, 10, 11, 14]))) for i in range(12)] + [(99, None), (98, "..."), (97, "A, b! C"), (97, "a b c")]
    docs = {i: some(r.randint(0, 60)) for i in range(40)}
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    want = plain(docs, items)
    assert values(dc.decontaminate(d, b)) == want
    assert values(dc.decontaminate(d, b, shard_words=30)) == want
    assert {x.doc_id for x in dc.keep_clean(d, b).collect()} == {x.doc_id for x in dc.keep_clean(d, b, shard_words=30).collect()} == {i for i, w in want.items() if not w[4]}


def test_edges(spark, edge, nothing):
    b = spark.createDataFrame([(1, prose(12)), (None, "one two"), (2, None)], "item_id long, text string")
    rows = dc.decontaminate(edge, b).collect()
    assert len(rows) == edge.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].n_words == 0 and by[4].contaminated and (by[11].n_hit, by[11].n_items) == (2, 0)
    kept = dc.keep_clean(edge, b)
    assert kept.columns == edge.columns and {1, 2, 3} <= {r.doc_id for r in kept.collect()} and 4 not in {r.doc_id for r in kept.collect()}
    assert dc.decontaminate(nothing, b).count() == 0 and dc.decontaminate(edge, b.limit(0)).where("contaminated").count() == 0
