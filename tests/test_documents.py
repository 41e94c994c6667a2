import ast

import numpy as np
import pytest

from tidewell.operators.chunking import chunk_documents, chunk_text, effective_size, word_count
from tidewell.operators.embedding import HashingEmbedder, index_documents, reindex
from tidewell.plans import mutations
from tidewell.tables import Tables


def invariants(name, text, size, overlap):
    out = chunk_text(name, text, size, overlap)
    for c in out:
        assert c and c == c.strip() and c in text and word_count(c) <= size
    return out


def test_blank_text_has_no_chunks():
    assert chunk_text("a.txt", " \n\t ", 4, 1) == []


@pytest.mark.parametrize(("name", "size", "overlap"), [("a.unknown", 3, 1), ("a.txt", 2, 2), ("a.txt", 1, 5)])
def test_words_are_covered(name, size, overlap):
    text = "one two three four five six seven eight"
    out = invariants(name, text, size, overlap)
    assert set(" ".join(out).split()) == set(text.split())


def test_code_and_markdown_paths():
    rust = "fn a() { one }\nfn b() { two }\nfn c() { three }\n"
    assert len(invariants("x.rs", rust, 4, 1)) >= 3
    md = "# Title\nsome words\n\n## One\nmore words here\n\n## Two\nand the last ones\n"
    assert any(c.startswith("## Two") for c in invariants("x.md", md, 6, 1))
    py = "import os\n\ndef a():\n    return 1\n\n@d\ndef b():\n    return 2\n"
    for c in invariants("x.py", py, 8, 0):
        ast.parse(c)
    assert invariants("x.py", "def broken(:\n  words " * 5, 4, 1)


def test_size_settings():
    assert effective_size(0, 0) == (1024, 100)
    assert effective_size(0, 0, (512, 100)) == (512, 100)
    assert effective_size(9999, 9999, context=2048) == (2048, 2047)


def test_one_bad_document_does_not_stop_the_rest(spark):
    def sizer(text):
        if "bad" in text:
            raise RuntimeError("no")
        return len(text.split())

    docs = spark.createDataFrame([(1, "a.txt", "fine words"), (2, "b.txt", "bad words"), (3, "c.txt", None)], "doc_id long, name string, text string")
    rows = {r.doc_id: r for r in chunk_documents(docs, 10, 0, sizer).collect()}
    assert rows[1].chunk_text == "fine words" and rows[2].error == "RuntimeError: no" and 3 not in rows


def test_a_worker_without_memory_is_no_bad_document(spark):
    """Its task fails and is run again; the documents aren't given as ones without chunks."""

    def sizer(text):
        raise MemoryError

    docs = spark.createDataFrame([(1, "a.txt", "fine words")], "doc_id long, name string, text string")
    with pytest.raises(Exception, match="MemoryError"):
        chunk_documents(docs, 10, 0, sizer).collect()


def test_hashing_embedder():
    v = HashingEmbedder(64).embed(["a cat sat", "dogs", "the cat", "a dog", "a cat sat"])
    assert np.allclose(np.linalg.norm(v, axis=1), 1, atol=1e-3) and np.allclose(v[0] @ v[4], 1, atol=1e-2)
    assert not HashingEmbedder(64).embed([""]).any()


def test_index_and_reindex(spark):
    schema = "doc_id long, name string, text string, tags array<string>"
    docs = spark.createDataFrame([(1, "a.md", "one two three four", ["x"]), (2, "b.md", "five six", [])], schema)
    table, failed = index_documents(docs, 2, 0)
    assert failed.count() == 0
    assert [r.chunk_index for r in table.where("doc_id = 1").orderBy("chunk_index").collect()] == [0, 1]
    new, _ = reindex(table, spark.createDataFrame([(1, "a.md", "only", ["y"])], schema), size=2, overlap=0)
    assert sorted((r.doc_id, r.chunk_text) for r in new.collect()) == [(1, "only"), (2, "five six")]


def test_mutations(spark, tmp_path):
    before = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    rows = spark.createDataFrame([(2, "B"), (3, "C")], "k long, v string")
    got = lambda df: sorted(map(tuple, df.collect()))
    assert got(mutations.upsert(before, rows, ["k"], ["v"])) == [(1, "a"), (2, "B"), (3, "C")]
    assert got(mutations.upsert(before, rows, ["k"], [])) == [(1, "a"), (2, "b"), (3, "C")]
    assert got(mutations.insert_missing(before, rows, ["k"])) == [(1, "a"), (2, "b"), (3, "C")]
    assert got(mutations.replace_matching(before, rows, ["k"])) == [(1, "a"), (2, "B"), (3, "C")]
    assert got(mutations.delete_matching(before, rows, ["k"])) == [(1, "a")]
    assert mutations.truncate(before)[1] == 2
    tables = Tables(spark, str(tmp_path / "t"))
    tables.change(lambda now: {"t": before})
    tables.change(lambda now: {"t": mutations.append(now.read("t"), rows).coalesce(1)})
    assert tables.read("t").count() == 4 and mutations.table_size(spark, f"{tables.root}/{tables.snapshot().parts('t')[0]['path']}") > 0
