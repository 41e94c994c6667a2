import pytest

from tidewell.knowledge_base import KnowledgeBase, document_id
from tidewell.operators.search import Settings

NEW = "name string, kind string, content string, tags array<string>"


@pytest.fixture()
def base(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path / "kb"), Settings(0.5, 0.5, 10, 0.2), chunk_size=4, chunk_overlap=1)
    rows = [("notes", "md", "# Cats\nthe cat sat on the mat", ["animal", " "]), ("a/b", ".txt", "dogs run fast over fields", ["Animal", "dog"]), ("..", "md", "x", [])]
    made = kb.create(spark.createDataFrame(rows, NEW)).collect()
    assert len(made) == 2 and all(r.error is None for r in made)
    return kb


def test_create_search_and_get(base):
    best = base.search("cat mat").first()
    assert best.doc_name == "notes.md" and best.title == "Cats"
    assert {r.doc_name for r in base.search("the cat dogs", tags=["ANIMAL"]).collect()} == {"notes.md", "a-b.txt"}
    assert {r.tag: r.file_count for r in base.tag_search(["ANIM"]).collect()} == {"animal": 1, "Animal": 1}
    own = base.chunks_of(document_id("notes.md")).collect()
    assert [r.chunk_index for r in own] == list(range(len(own))) and base.get(document_id("a-b.txt")).first().size == 25


def test_changes(spark, base):
    notes, dogs = document_id("notes.md"), document_id("a-b.txt")
    base.create(spark.createDataFrame([("notes.md", "md", "only birds", ["bird"])], NEW))
    assert base.docs().count() == 2 and [r.chunk_text for r in base.chunks_of(notes).collect()] == ["only birds"]
    base.update(spark.createDataFrame([(notes, "and fish")], "doc_id string, content string"), append_text=True)
    assert base.get(notes).first().content == "only birds\nand fish" and "fish" in base.chunks_of(notes).collect()[-1].chunk_text
    before = {r.id for r in base.chunks_of(dogs).collect()}
    base.set_tags(spark.createDataFrame([(dogs, ["new"])], "doc_id string, tags array<string>"))
    after = base.chunks_of(dogs).collect()
    assert {r.id for r in after} == before and all(r.tags == ["new"] for r in after)
    assert base.reindex().count() == 0
    base.delete(spark.createDataFrame([(dogs,)], "doc_id string"))
    assert base.docs().count() == 1 and base.chunks_of(dogs).count() == 0


def test_tags_names_and_files(spark, base, monkeypatch):
    from tidewell.operators import documents

    notes, dogs = document_id("notes.md"), document_id("a-b.txt")
    schema = "doc_id string, name string, add_tags array<string>, remove_tags array<string>"
    rows = [(notes, "new/name.md", [" Cat ", "ANIMAL", "cat"], None), (dogs, "..", None, [" DOG", ""]), ("nobody", "x", None, None)]
    refused = base.update(spark.createDataFrame(rows + rows[:1], schema)).collect()
    assert [(r.doc_id, r.error) for r in refused] == [("nobody", "not found")]
    got = {r.doc_id: r for r in base.docs().collect()}
    assert (got[notes].name, got[notes].tags, got[notes].version) == ("new-name.md", ["animal", "Cat"], 1)
    assert (got[dogs].name, got[dogs].tags) == ("a-b.txt", ["Animal"])
    assert all(r.tags == ["animal", "Cat"] for r in base.chunks_of(notes).collect())
    base.update_files(spark.createDataFrame([(dogs, "c.md", "# Two\ncats now")], "doc_id string, name string, content string"))
    after = base.get(dogs).first()
    assert (after.name, after.title, after.version, after.tags, after.size) == ("c.md", "Two", 2, ["Animal"], 14)
    assert after.chunk_count == base.chunks_of(dogs).count() > 0 and base.get(notes).first().version == 1
    assert base.listed().first().doc_id == dogs and [r.doc_id for r in base.listed("C.M").collect()] == [dogs]
    monkeypatch.setattr(documents.too_large, "__defaults__", (5,))
    refused = base.update(spark.createDataFrame([(notes, "longer than five")], "doc_id string, content string")).collect()
    assert [(r.doc_id, r.error) for r in refused] == [(notes, "too large")] and base.get(notes).first().content.startswith("# Cats")


def test_stored_tag_statistics_follow_any_chain_of_changes(spark, tmp_path):
    """After each of a random chain of changes the stored counts are those of a recount."""
    import random

    from tidewell.operators import documents

    rng = random.Random(11)
    kb = KnowledgeBase(spark, str(tmp_path / "kb"), chunk_size=8, chunk_overlap=0)
    names = [f"n{i}.md" for i in range(6)]
    some_tags = lambda: [rng.choice(["a", "A", "b", "c", "", " b "]) for _ in range(rng.randint(0, 4))]
    counts = lambda df: {r.tag: r.file_count for r in df.collect()}
    for _ in range(14):
        chosen = rng.sample(names, rng.randint(1, 3))
        ids = [document_id(n) for n in chosen]
        step = rng.choice(["create", "create", "set", "edit", "delete", "files", "content"])
        if step == "create":
            kb.create(spark.createDataFrame([(n, "md", f"text of {n} {rng.random()}", some_tags()) for n in chosen], NEW))
        elif step == "set":
            kb.set_tags(spark.createDataFrame([(i, some_tags()) for i in ids], "doc_id string, tags array<string>"))
        elif step == "edit":
            kb.update(spark.createDataFrame([(i, some_tags(), some_tags()) for i in ids], "doc_id string, add_tags array<string>, remove_tags array<string>"))
        elif step == "delete":
            kb.delete(spark.createDataFrame([(i,) for i in ids], "doc_id string"))
        elif step == "files":
            kb.update_files(spark.createDataFrame([(i, n, "new text") for i, n in zip(ids, chosen, strict=True)], "doc_id string, name string, content string"))
        else:
            kb.update(spark.createDataFrame([(i, "more") for i in ids], "doc_id string, content string"), append_text=True)
        assert counts(kb.tag_stats()) == counts(documents.tag_stats(kb.docs()))
    kb.compact()
    stored = counts(kb.tag_stats())
    kb.rebuild_tag_stats()
    assert counts(kb.tag_stats()) == stored == counts(documents.tag_stats(kb.docs()))


def test_reports_outlive_the_change(spark, base):
    """What a change reports is written with it, so later changes don't alter it."""
    schema = "doc_id string, content string"
    refused = base.update(spark.createDataFrame([(f"no{i}", "x") for i in range(50)], schema))
    made = base.create(spark.createDataFrame([("new.md", "md", "one two three four five six", []), ("empty.md", "md", "", None)], NEW))
    base.delete(base.docs().select("doc_id"))
    assert refused.count() == 50 and base.docs().count() == base.chunks().count() == base.tag_stats().count() == 0
    assert {r.doc_id: (r.chunk_count, r.error) for r in made.collect()} == {document_id("new.md"): (2, None), document_id("empty.md"): (0, None)}


def test_an_update_holds_its_changes_once(spark, base, monkeypatch):
    """Plans after it read the written changes; the old texts aren't moved for each of them."""
    held, real = [], KnowledgeBase._held
    monkeypatch.setattr(KnowledgeBase, "_held", lambda self, rows: held.append(rows.columns) or real(self, rows))
    base.update(spark.createDataFrame([(document_id("notes.md"), "more")], "doc_id string, content string"), append_text=True)
    assert held[0] == ["doc_id", "content", "_large"]


def test_nothing_is_appended_to_no_content(spark, base):
    base.create(spark.createDataFrame([("none.md", "md", None, []), ("other.md", "md", None, [])], NEW))
    base.update(spark.createDataFrame([(document_id(n), "more") for n in ("none.md", "notes.md")], "doc_id string, content string"), append_text=True)
    assert {r.name: (r.content, r.size) for r in base.docs().collect() if r.name != "a-b.txt"} == {
        "none.md": (None, None), "other.md": (None, None), "notes.md": ("# Cats\nthe cat sat on the mat\nmore", 34),
    }
