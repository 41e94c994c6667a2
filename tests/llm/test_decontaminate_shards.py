from tests.llm.conftest import prose
from tidewell.llm import decontaminate as dc

COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_edges_are_the_same_in_many_shards(spark, edge, nothing):
    b = spark.createDataFrame([(1, prose(12)), (None, "one two"), (2, None), (3, "a"), (4, prose(14, 1))], "item_id long, text string")
    whole = rows(dc.decontaminate(edge, b))
    assert len(whole) == edge.count()
    assert dc.shards(b, 10, 12).count() > 1
    assert rows(dc.decontaminate(edge, b, shard_words=12)) == whole
    assert dc.decontaminate(nothing, b, shard_words=12).count() == 0


def test_rows_with_one_id_keep_their_own_hits(spark):
    b = spark.createDataFrame([(1, "one two"), (2, "three four"), (3, "five six")], "item_id long, text string")
    texts = [(7, "one two x"), (7, "y three four"), (7, "x y z"), (7, "x y z"), (None, "one two x"), (None, "five six five"), (None, "a b c")]
    d = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = [r[:4] for r in rows(dc.decontaminate(d, b, shard_words=3))]
    assert sorted(got, key=repr) == sorted([(7, 3, 2, 1), (7, 3, 2, 1), (7, 3, 0, 0), (7, 3, 0, 0), (None, 3, 2, 1), (None, 3, 2, 1), (None, 3, 0, 0)], key=repr)


def test_tables_are_small_and_items_are_cut():
    """A long item in pieces finds what it finds whole; tables take tens of bytes a word."""
    import pickle
    import random

    r = random.Random(2)
    item = [b"w%d" % r.randrange(50_000) for _ in range(100_000)]
    pieces = [("x", item[a : a + (1 << 15) + 9]) for a in range(0, len(item) - 9, 1 << 15)]
    tables, names = dc.pattern_tables(pieces)
    assert names == ["x"] and [t.m for t in tables] == [10]
    assert len(pickle.dumps((tables, names))) < 60 * len(item)
    for at in (0, 32_760, 32_768, 65_531, 99_990):
        text = [b"no"] * 7 + item[at : at + 10] + [b"no"] * 3
        assert dc.scan(text, tables) == ([7, 17], {0})
        text[9] = b"other"
        assert dc.scan(text, tables) == ([], set())


def test_windows_of_one_suffix():
    """Thousands of patterns that end alike are told apart by their first words."""
    pieces = [(i, [b"a%d" % i, b"b%d" % i, *[b"x"] * 8]) for i in range(3000)]
    tables, _ = dc.pattern_tables(pieces)
    assert dc.scan([b"z", b"a7", b"b7", *[b"x"] * 8, b"a8"], tables)[1] == {7}


def test_keep_clean_holds_one_shard_at_a_time(spark, edge, nothing):
    """Any number of shards gives the rows that one gives, and the plan's only worker is that of the last."""
    b = spark.createDataFrame([(i, f"w{i} x{i} y{i}", "t") for i in range(40)] + [(99, prose(12), "t")], "item_id long, text string, lang string")
    d = spark.createDataFrame([(i, f"a w{i} x{i} y{i} b" if i % 3 else f"a w{i} b", "en") for i in range(60)] + [(None, None, None), (1, prose(300), "x"), (1, "", "x")], "doc_id long, text string, lang string").repartition(3)
    assert dc.shards(b, 10, 3).count() >= 20
    many, one = dc.keep_clean(d, b, shard_words=3), dc.keep_clean(d, b)
    assert sorted(map(repr, many.collect())) == sorted(map(repr, one.collect())) and 20 < one.count() < 63
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert dc.keep_clean(nothing, b, shard_words=3).count() == 0 and dc.keep_clean(edge, b.limit(0)).count() == edge.count()
