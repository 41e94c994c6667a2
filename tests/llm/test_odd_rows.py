"""Rows that share an id but not a text, and tables whose other columns clash."""

from tests.llm.conftest import SCHEMA, prose, row
from tidewell.llm import decontaminate, fingerprint, packing, simhash, tokens, toxicity


def test_simhash_components_of_rows_that_share_an_id(spark):
    a, b = prose(300, 1), prose(300, 5)
    rows = [row(7, a), row(7, b), row(3, b), row(9, a), row(9, None), row(4, ""), row(None, a)]
    found = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(found) == len(rows)
    prints = {r.fingerprint for r in found}
    assert len(prints) == 3
    by = {}
    for r in found:
        by.setdefault((r.doc_id, r.fingerprint), set()).add(r.component_id)
    of = {f: min(i for (i, g) in by if g == f and i is not None) for f in prints}
    assert all(components == ({None} if i is None else {of[f]}) for (i, f), components in by.items()), "a row's group is that of its own text"


def test_fingerprints_of_rows_that_share_an_id(spark):
    texts = [(5, "a\nb\nc"), (5, "d\ne"), (5, "d\ne"), (2, None), (2, "x" * 300_000), (None, "a\nb\nc")]
    found = fingerprint.fingerprints(spark.createDataFrame([row(*x) for x in texts], SCHEMA).repartition(3)).collect()
    assert sorted(((r.doc_id or 0), r.n_chars) for r in found) == sorted(((i or 0), len(t or "")) for i, t in texts)
    prints = {}
    for r in found:
        prints.setdefault(r.n_chars, set()).add(r.fingerprint)
    assert {n: len(p) for n, p in prints.items()} == {5: 1, 3: 1, 0: 1, 300_000: 1}
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and len(r.edited_sha256) == 64 for r in found)


def test_labels_and_items_with_clashing_columns(spark):
    docs = spark.createDataFrame([row(i, "good words here " * 5 + "scum " * (i % 2)) for i in range(60)], SCHEMA)
    labels = spark.createDataFrame([(i, 1, i % 2, "text", "en", 5, 0.5, True) for i in range(40)], "doc_id long, quality int, toxic int, text string, lang string, node long, p_toxic double, found boolean")
    assert {(r.doc_id, r.toxic) for r in toxicity.classify(docs, labels).collect()} == {(i, i % 2 == 1) for i in range(60)}
    assert toxicity.keep_clean(docs, labels).columns == docs.columns and toxicity.keep_clean(docs, labels).count() == 30
    items = spark.createDataFrame([(1, "good words here good words here good words here good", "x", 1, 2)], "item_id long, text string, lang string, doc_id long, row long")
    assert {r.contaminated for r in decontaminate.decontaminate(docs, items).collect()} == {True} and decontaminate.keep_clean(docs, items).count() == 0


def test_very_long_texts_are_whole(spark):
    import public_tokenizers

    long = prose(60_000, 2) + " é" * 1000
    assert len(long) > 200_000
    docs = spark.createDataFrame([row(1, long), row(2, "b"), row(3, None)], SCHEMA)
    counted = {r.doc_id: r for r in tokens.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert counted[1].n_bytes == len(long.encode()) and counted[1].over_limit and counted[3].n_tokens == 0
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert {r.doc_id for r in pieces} == {1, 2, 3} and sum(r.length for r in pieces if r.doc_id == 3) == 1
    own = sorted((r.piece, r.start, r.length) for r in pieces if r.doc_id == 1)
    assert [p for p, *_ in own] == list(range(len(own))) and all(a[1] + a[2] == b[1] for a, b in zip(own, own[1:])) and all(x[2] == 4096 for x in own[:-1])
