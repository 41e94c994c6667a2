import hashlib
import random

import pytest

from tidewell.llm import substrings


def plain(docs, window=50):
    first, out = {}, {}
    for i, text in sorted(docs.items()):
        words = text.encode().split()
        gone = [False] * len(words)
        for p in range(len(words) - window + 1):
            if first.setdefault(tuple(words[p : p + window]), i) < i:
                gone[p : p + window] = [True] * window
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out[i] = (len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def check(df, docs):
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()} == plain(docs)


def test_against_brute_force(documents, texts):
    check(substrings.remove_repeats(documents), texts)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_shared_passages(spark, seed):
    r = random.Random(seed)
    word = lambda: r.choice(["a", "b", "c", "dd", "ee"])  # noqa: E731 - few words, so many equal runs
    shared = [[word() for _ in range(r.choice([49, 50, 51, 80, 200]))] for _ in range(4)]
    docs = {}
    for i in range(40):
        parts = [[word() for _ in range(r.randint(0, 60))] for _ in range(3)]
        docs[i * 3] = " ".join(sum(parts[:1] + [r.choice(shared)] + parts[1:2] + [r.choice(shared)] + parts[2:], []))
    docs[500] = "z " * 400
    docs[501] = "z " * 90
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    check(substrings.remove_repeats(df), docs)


def test_repeats_within_one_document_stay(spark):
    text = " ".join(f"w{i % 60}" for i in range(240))
    row = substrings.remove_repeats(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_removed, row.kept_text) == (0, text)


def test_edges(edge, nothing):
    rows = substrings.remove_repeats(edge).collect()
    assert len(rows) == edge.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.n_words, r.n_removed))
    assert by[1] == [(0, 0)] and by[5] == [(120, 120)] * 2 and by[4] == [(120, 0)] and by[10] == [(180, 120)] and (30, 0) in by[None]
    assert substrings.remove_repeats(nothing).count() == 0


def test_paths_are_compacted(spark):
    """A chain of nodes has one head; a branch ends it, and a circle isn't followed."""
    def rows(doc, nodes, first=1):
        return [(doc, ord(x), 0, 10 * i, 10, first) for i, x in enumerate(nodes)]

    schema = "doc_id long, h1 long, h2 long, start int, n int, first long"
    got = lambda r: {chr(x.node.h1): (chr(x.head.h1), x.rank, x.words) for x in substrings.compacted(spark.createDataFrame(r, schema)).collect()}
    assert got(rows(1, "abcdefg") + rows(2, "cdef")) == {c: ("a", i, 10 * i) for i, c in enumerate("abcdefg") if i}
    assert got(rows(1, "abcd") + rows(2, "abxd")) == {"b": ("a", 1, 10)}
    assert got(rows(1, "pabab")) == {"b": ("a", 1, 10)} and got(rows(1, "a")) == {}
    assert got(rows(1, "abca", 1)) == {}
    long = "".join(chr(200 + i) for i in range(700))
    assert got(rows(1, long)) == {c: (long[0], i, 10 * i) for i, c in enumerate(long) if i}


def test_a_path_with_a_hole_keeps_its_hole(spark):
    schema = "doc_id long, h1 long, h2 long, start int, n int, first long"
    whole = [(1, i, 0, 10 * i, 10, 1) for i in range(6)]
    part = [(2, i, 0, 10 * i, 10, 1) for i in (0, 1, 4, 5)]
    spans = {(x.start, x.stop) for x in substrings.path_spans(spark.createDataFrame(whole + part, schema), 50).collect()}
    assert {p for a, z in spans for p in range(a, z)} == set(range(0, 69)) | set(range(40, 109)) and (0, 109) not in spans
    spans = [(x.doc_id, x.start, x.stop) for x in substrings.path_spans(spark.createDataFrame(whole + [(3, *x[1:]) for x in whole], schema), 50).collect()]
    assert spans == [(3, 0, 109)]


def plain_rows(rows, window=50):
    """As ``plain``, row by row: what a row loses is judged by its own words and by documents of smaller ids."""
    first = {}
    words_of = [(i, (t or "").encode().split()) for i, t in rows]
    for i, words in words_of:
        for p in range(len(words) - window + 1 if i is not None else 0):
            key = tuple(words[p : p + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, words in words_of:
        gone = [False] * len(words)
        for p in range(len(words) - window + 1 if i is not None else 0):
            if first[tuple(words[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out.append((i or 0, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_rows_that_share_an_id(spark, seed):
    r = random.Random(seed)
    a, b, own = (" ".join(f"{x}{r.randint(0, 99)}" for _ in range(n)) for x, n in (("a", 300), ("b", 300), ("c", 301)))
    mixed = [" ".join(r.choice([a, b, own]).split()[r.randint(0, 150) : r.randint(200, 300)] + ["z"] * r.randint(0, 60)) for _ in range(25)]
    for rows in (
        [(1, a), (2, a), (2, "short text")], [(1, a), (2, own), (2, a)], [(1, a), (1, a), (1, b), (2, b + " " + a), (2, None), (None, a), (None, a)],
        [(r.choice([None, 1, 2, 3, 4]), t) for t in mixed],
    ):
        df = spark.createDataFrame([(*x, 7, 8) for x in rows], "doc_id long, text string, tie long, start long").repartition(3)
        assert sorted((x.doc_id or 0, x.n_words, x.n_removed, x.kept_sha256) for x in substrings.remove_repeats(df).collect()) == plain_rows(rows)
