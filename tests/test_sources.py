import json

import pytest

from tidewell.sources import files
from tidewell.sources.rest import RegistrySource


def test_uploads(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Hi\nthere", encoding="utf-8")
    (tmp_path / "b.txt").write_bytes("﻿mark".encode())
    (tmp_path / "c.bin").write_bytes(b"\x00\x01")
    (tmp_path / "d.txt").write_bytes("中文".encode("gb18030"))
    (tmp_path / "e.txt").write_bytes(b"")
    rows = {r.name: r for r in files.read_uploads(spark, str(tmp_path)).collect()}
    assert rows["a.md"].title == "Hi" and rows["b.txt"].text == "mark" and rows["c.bin"].error == "not text" and rows["d.txt"].text == "中文"
    assert (rows["e.txt"].size, rows["e.txt"].text, rows["e.txt"].title, rows["e.txt"].error) == (0, "", "e", None) and len(rows) == 5


def test_large_uploads_are_judged_by_the_listing(spark, tmp_path):
    """A file of over two gigabytes is told by its size: nothing of it is read, and no other file suffers."""
    (tmp_path / "deep er").mkdir()
    with open(tmp_path / "deep er" / "huge %41.bin", "wb") as f:
        f.truncate((2 << 30) + 12345)
    with open(tmp_path / "wide.txt", "wb") as f:
        f.truncate(files.MAX_BYTES + 1)
    (tmp_path / "edge.txt").write_text("x" * 100)
    (tmp_path / "deep er" / "é #1.txt").write_text("")
    (tmp_path / "fine.txt").write_text("# T\nfine")
    got = {r.name: r for r in files.read_uploads(spark, str(tmp_path)).collect()}
    assert {n: r.error for n, r in got.items()} == {"huge %41.bin": "too large", "wide.txt": "too large", "edge.txt": None, "é #1.txt": None, "fine.txt": None}
    assert got["huge %41.bin"].size == (2 << 30) + 12345 and got["huge %41.bin"].text is None and got["é #1.txt"].text == ""
    less = {r.name: r.error for r in files.read_uploads(spark, str(tmp_path), most=99).collect()}
    assert less["edge.txt"] == "too large" and less["fine.txt"] is None
    plan = files.read_uploads(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("content#") and plan.count("LessThanOrEqual(length") == 1
    assert {r.name: r.size for r in files.list_files(spark, str(tmp_path), "*.txt").collect()} == {"wide.txt": files.MAX_BYTES + 1, "edge.txt": 100, "é #1.txt": 0, "fine.txt": 8}


def test_agent_folders(spark, tmp_path):
    from tidewell.sources.agents import AgentSource, scan_agents

    lib, one, two = (tmp_path / n for n in ("lib", "one", "two"))
    for d in (lib / "known", one / "real", one / "known", one / "bare", two, tmp_path / "away"):
        d.mkdir(parents=True)
    (one / "real" / "SKILL.md").write_text("---\nname: Real\ndescription: does it\n---")
    (tmp_path / "away" / "skill.md").write_text("---\nname: Away\n---")
    (one / "note.txt").write_text("x")
    (two / "linked").symlink_to(tmp_path / "away")
    (two / "export").symlink_to(lib / "known")
    (two / "broken").symlink_to(tmp_path / "nowhere")
    (two / "to_file").symlink_to(one / "note.txt")
    agents = [{"id": "1", "name": "One", "path": str(one)}, {"id": "2", "name": "Two", "path": str(two)}, {"id": "3", "name": "None", "path": str(tmp_path / "missing")}, {"id": "4", "name": "Null", "path": None}, {"id": "5", "name": "File", "path": str(one / "note.txt")}]
    got = scan_agents(spark, agents, str(lib)).collect()
    assert sorted((r.agent_id, r.dir_name, r.name, r.description, r.is_symlink, r.already_imported) for r in got) == [
        ("1", "bare", "bare", "", False, False), ("1", "known", "known", "", False, True), ("1", "real", "Real", "does it", False, False), ("2", "linked", "Away", "", True, False),
    ]
    kinds = spark.read.format(AgentSource.name()).option("agents", json.dumps(agents)).option("library", str(lib)).load()
    assert {r.dir_name: r.kind for r in kinds.where("agent_id = '2'").collect()} == {"linked": "link", "export": "own", "broken": "broken", "to_file": "file"}
    assert kinds.rdd.getNumPartitions() == len(agents) and scan_agents(spark, []).count() == 0


def test_api_descriptions(spark):
    import urllib.error

    from tidewell.functions.json import base_url
    from tidewell.sources.api_specs import load_specs

    def fetch(url, headers):
        if "gone" in url:
            raise urllib.error.HTTPError(url, 404, "gone", {}, None)
        if "down" in url:
            raise OSError("no route")
        return "<html>" if "html" in url else json.dumps({"from": url, "host": headers.get("x", "h.test")})

    inline = '{"servers": [{"url": "http://inline.test"}]}'
    rows = [
        ("both", inline, "http://u/", {"x": "y"}), ("inline", inline, None, None), ("url", None, "http://u/", {"x": "y.test"}), ("empty", "", "http://u/", {}), ("gone", None, "http://gone/", None),
        ("down", None, "http://down/", None), ("html", None, "http://html/", None), ("broken", "{", "http://u/", None), ("none", None, None, None),
    ]
    servers = spark.createDataFrame(rows, "name string, spec_schema string, spec_url string, headers map<string, string>").repartition(3)
    got = {r.name: r for r in load_specs(servers, fetch).collect()}
    assert {n: r.origin for n, r in got.items()} == {"both": "inline", "inline": "inline", "url": "url", "empty": "url", "gone": "url", "down": "url", "html": "url", "broken": "inline", "none": None}
    assert base_url(json.loads(got["both"].spec)) == "http://inline.test" and base_url(json.loads(got["url"].spec)) == "https://y.test"
    assert (got["gone"].error, got["down"].error) == ("HTTP 404", "OSError: no route") and got["html"].error.startswith("not JSON") and got["broken"].error.startswith("not JSON")
    assert got["none"].error == "no spec_url or spec_schema configured" and all((r.error is None) == (r.spec is not None) for r in got.values())


def test_sniffer():
    assert files.likely_text(b"") and files.likely_text("é".encode()) and not files.likely_text(b"a\x00") and not files.likely_text(b"\x01\x02\x03abcdefg"[:9])
    assert files.likely_text(b"\x01\x02abcdefgh")


def test_metadata_fails_or_skips(spark, tmp_path):
    (tmp_path / "1.meta").write_text(json.dumps({"id": "1", "name": "a", "uploaded_at": "2024-01-01 10:00:00", "tags": ["x"]}))
    (tmp_path / "2.meta").write_text(json.dumps({"id": "2", "name": "b", "uploaded_at": "2024-01-02 10:00:00"}))
    assert [r.id for r in files.read_metadata(spark, str(tmp_path)).collect()] == ["2", "1"]
    (tmp_path / "3.meta").write_text("{broken")
    assert {r.id for r in files.read_metadata(spark, str(tmp_path), strict=False).collect()} == {"1", "2"}
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        files.read_metadata(spark, str(tmp_path)).collect()


def test_front_matter():
    assert files.front_matter("---\nname: 'x y'\ndescription: >-\n  one\n  two\nother: 1\n---\nbody", "d") == ("x y", "one two")
    assert files.front_matter("---\ndescription: |\n  one\n  two\n---", "d") == ("d", "one\ntwo")
    assert files.front_matter("no matter", "d") == ("d", "")


def test_skills_and_directories(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
    (tmp_path / "one" / "SKILL.md").write_text("---\nname: First\n---")
    (tmp_path / "two" / "x.txt").write_text("x")
    assert [(r.dir_name, r.name) for r in files.read_skills(spark, str(tmp_path)).collect()] == [("one", "First")]
    assert {r.dir_name for r in files.list_directories(spark, str(tmp_path)).collect()} == {"one", "two"}
    own = files.read_skills(spark, str(tmp_path / "one")).collect()
    assert [r.name for r in own] == ["First"]


def test_models(spark, tmp_path):
    for place in ("b/1m/w.gguf", "a/2m/deploy.json", "c/3m/readme.md"):
        (tmp_path / place).parent.mkdir(parents=True)
        (tmp_path / place).write_text("x")
    assert [(r.family, r.status) for r in files.read_models(spark, str(tmp_path)).collect()] == [("b", "ready"), ("a", "downloadable"), ("c", "unavailable")]


def test_event_stream_lines(spark):
    lines = spark.createDataFrame([('data: {"id": 1, "x": 2}',), (": comment",), ("data: broken",), ('data: {"id": 2}',)], "value string")
    assert [r.payload for r in files.sse_messages(lines, "1").collect()] == ['{"id": 1, "x": 2}']
    assert files.sse_messages(lines).count() == 2


def test_registry_pages(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text(json.dumps([{"name": f"s{i}"} for i in range(7)]))
    spark.dataSource.register(RegistrySource)
    read = lambda **o: spark.read.format("registry").options(urls=f"file://{path}", **o).load()
    assert sorted(r.name for r in read(limit=3).collect()) == [f"s{i}" for i in range(7)]
    assert [r.name for r in read(search="S4").collect()] == ["s4"]


def test_day_logs(spark, tmp_path):
    lines = spark.createDataFrame([("2024-01-01", "a"), ("2024-01-02", "b")], "day string, line string")
    files.write_log_files(lines, str(tmp_path / "log"))
    got = files.day_log_files(spark, str(tmp_path / "log")).where("day >= '2024-01-02'").collect()
    assert [(r.day, r.line) for r in got] == [("2024-01-02", "b")]
