import hashlib
import pathlib
import random
import re

import duckdb
import pandas as pd
import xxhash
from pyspark.sql import functions as F

from tests.oracle import assert_same, connect
from tidewell.llm import fingerprint, licenses


def test_licenses_against_sql(spark, sf_dir, documents):
    assert_same(licenses.scan(documents), connect(sf_dir).sql(licenses.oracle()))


def test_license_spellings(spark):
    mit = licenses.TEXTS["MIT"]
    rows = [
        (1, "MIT LICENCE\n\nCopyright (c) 2020 Someone\n" + mit.split("\n\n", 1)[1].replace(" and/or ", " and / or ")), (2, mit + " More."), (3, "words\nreleased under the MIT licence!\nwords"),
        (4, "Licensed under the Apache License, v2.0".replace("v2.0", "version 2.0")), (5, "© 2021 me\nAll rights reserved.\n"),
    ]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].license == "MIT" and got[2].license is None and (got[3].notices, got[3].n_notices) == ("MIT", 1) and got[4].license == "Apache-2.0"
    assert all(licenses.digest(t) == d for (d, t) in [(r.digest, x[1]) for x in rows for r in [got[x[0]]]])


def test_license_edges(edge, nothing):
    rows = licenses.scan(edge).collect()
    assert len(rows) == edge.count() and {r.digest for r in rows if r.doc_id in (1, 2, 3)} == {hashlib.sha256(b"").hexdigest()}
    assert licenses.scan(nothing).count() == 0


def edited(docs):
    ordered, out = sorted(docs.items(), reverse=True), {}
    for i, (k, x) in enumerate(ordered):
        y, half = ordered[(i + 1) % len(ordered)][1], len(x) // 2
        out[k] = (len(x), hashlib.sha256((x[: len(x) - half] + y[:half]).encode()).hexdigest())
    return out


def test_edited_texts(documents, texts):
    rows = fingerprint.fingerprints(documents).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in rows} == edited(texts)
    prints = {}
    for r in rows:
        prints.setdefault(texts[r.doc_id], set()).add(r.fingerprint)
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 and (r.near_edited == 1) >= (r.fingerprint == r.edited_fingerprint)
    assert all(len(v) == 1 for v in prints.values()) and len({x for v in prints.values() for x in v}) == len(prints)
    assert sum(r.near_edited > r.near_next for r in rows) > 0.9 * len(rows)


def test_any_number_of_ranges(spark, documents, texts):
    for n in (1, 3, 64):
        base = documents.select("doc_id", "text").withColumn("tie", F.lit(0))
        got = {r.doc_id: r.next.text for r in fingerprint.following(base, ["text"], n).collect()}
        ids = sorted(texts, reverse=True)
        assert got == {k: texts[ids[(i + 1) % len(ids)]] for i, k in enumerate(ids)}


def test_ranges_of_edges(spark):
    for edges in ([], [5], [1, 2, 3], list(range(0, 50, 3)), list(range(7))):
        got = spark.range(-2, 60).select("id", fingerprint._below(F.lit(edges).cast("array<bigint>"), F.col("id")).alias("n")).collect()
        assert all(r.n == sum(e < r.id for e in edges) for r in got)


def test_ids_over_the_whole_range(spark):
    """Hashed ids lie further apart than a long holds."""
    ids = [-(2**63), -(2**62), -5, 0, 3, 2**62, 2**63 - 1]
    docs = spark.createDataFrame([(i, f"text {i}\nof {i % 3}") for i in ids], "doc_id long, text string").repartition(3)
    for n in (None, 1, 40):
        got = {r.doc_id: r.next.text for r in fingerprint.following(docs.withColumn("tie", F.lit(0)), ["text"], n).collect()}
        down = sorted(ids, reverse=True)
        assert got == {i: f"text {down[(k + 1) % len(ids)]}\nof {down[(k + 1) % len(ids)] % 3}" for k, i in enumerate(down)}
    assert fingerprint.fingerprints(docs).count() == len(ids)


def test_sums_and_differences(spark):
    rows = [("a\nb\nc", "c\n\nb", "a\nb\nc\nc\nb")]
    df = spark.createDataFrame(rows, "x string, y string, both string")
    for c in df.columns:
        df = fingerprint.with_vector(df, c, f"v_{c}")
    r = df.select(
        (fingerprint.combine(F.col("v_x"), F.col("v_y")) == F.col("v_both")).alias("add"), (fingerprint.combine(F.col("v_both"), F.col("v_y"), -1) == F.col("v_x")).alias("sub"),
        fingerprint.likeness(F.col("v_x"), F.col("v_x")).alias("same"),
    ).first()
    assert (r["add"], r["sub"], r["same"]) == (True, True, 1.0)


def test_order_does_not_matter(spark):
    df = spark.createDataFrame([(2, "one.\ntwo.\nthree."), (1, "three.\none.\ntwo.")], "doc_id long, text string")
    assert len({r.fingerprint for r in fingerprint.fingerprints(df).collect()}) == 1


def test_fingerprint_edges(spark, edge, nothing):
    rows = fingerprint.fingerprints(edge).collect()
    assert len(rows) == edge.count() and {r.doc_id: r.n_chars for r in rows}[1] == 0
    assert len({r.fingerprint for r in rows if r.doc_id in (1, 2, 3)}) == 1 and len({r.fingerprint for r in rows if r.doc_id in (4, 5)}) == 1
    assert fingerprint.fingerprints(nothing).count() == 0
    one = fingerprint.fingerprints(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1.0


def test_no_python_in_the_plan(documents):
    plan = fingerprint.fingerprints(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_canonical_form_is_its_own():
    words = [*licenses.EQUIVALENT, *licenses.EQUIVALENT.values(), "x", "C", "(c)", "licence licence", "per cent cent", "sub licence"]
    r = random.Random(1)
    for _ in range(3000):
        line = r.choice([" ", ", ", "-"]).join(r.choice(words) for _ in range(r.randint(1, 8)))
        once = licenses.canonical_line(line)
        assert licenses.canonical_line(once) == once
    assert licenses.canonical_line("Licence, licence X") == "license license x"


def test_column_and_sql_agree_with_plain(spark):
    r = random.Random(2)
    words = [*licenses.EQUIVALENT, "x", "Copyright", "(c)", "2020", "é", "https://", "..."]
    texts = ["\n".join(r.choice([" ", ", ", "  "]).join(r.choice(words) for _ in range(r.randint(0, 7))) for _ in range(r.randint(0, 4))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x.doc_id: x.digest for x in licenses.scan(docs).collect()} == {i: licenses.digest(t) for i, t in enumerate(texts)}
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    assert dict(con.sql(f"SELECT doc_id, digest FROM ({licenses.oracle()})").fetchall()) == {i: licenses.digest(t) for i, t in enumerate(texts)}


def test_whole_texts_are_known(spark):
    mit = licenses.TEXTS["MIT"].partition("\n\n")[2]
    texts = [f"The MIT License (MIT)\nCopyright (c) 2020 A. Body\n{mit}", mit.upper(), mit + "\nand more", licenses.TEXTS["BSD-3-Clause"].replace("1. ", "* "), licenses.TEXTS["Zlib"]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x.doc_id: x.license for x in licenses.scan(docs).collect()} == {0: "MIT", 1: "MIT", 2: None, 3: None, 4: "Zlib"}
    own = spark.createDataFrame([("Own-1.0", "You may.\nCopyright me"), ("Own-0.9", "you MAY"), (None, "x"), ("Own-2", None)], "license string, text string")
    docs = spark.createDataFrame([(1, "Copyright you\nYou may!"), (2, texts[1]), (3, None)], "doc_id long, text string")
    assert {x.doc_id: x.license for x in licenses.scan(docs, own).collect()} == {1: "Own-0.9", 2: "MIT", 3: None}


def test_digests_of_official_texts():
    files = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    for key, name in files.items():
        path = pathlib.Path("/usr/share/common-licenses") / name
        if path.exists():
            assert licenses.digest(path.read_text("utf-8")) == licenses.WHOLE[key]


def plain_vector(text):
    """Components of a fingerprint: 62 sums of bits, 4 of 32 bits, the number of paragraphs."""
    parts = [p for p in re.split(r"[\r\n]+|(?<=[.!?]) ", text) if re.search(r"[^ \t\n\x0b\f\r]", p)]
    bits, wide = [0] * 62, [0] * 4
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), 42)
        for i in range(62):
            bits[i] += h >> i & 1
        for k, salt in enumerate((1, 2)):
            v = xxhash.xxh64_intdigest(salt.to_bytes(4, "little"), h)
            wide[2 * k] += v & 0xFFFFFFFF
            wide[2 * k + 1] += v >> 32
    return bits, [w % (1 << 32) for w in wide], len(parts)


def plain_hex(text):
    bits, wide, n = plain_vector(text)
    return "".join(f"{v:016x}" for v in [bits[i] | bits[i + 31] << 31 for i in range(31)] + wide + [n])


def plain_likeness(a, b):
    if plain_hex(a) == plain_hex(b):
        return 1.0
    (x, _, n), (y, _, m) = plain_vector(a), plain_vector(b)
    x, y = [2 * v - n for v in x], [2 * v - m for v in y]
    total = sum(v * v for v in x) + sum(v * v for v in y)
    return 0.0 if not total else max(0.0, 1 - sum((p - q) ** 2 for p, q in zip(x, y)) / total)


def test_fingerprints_against_plain(spark, documents, texts):
    ids = sorted(texts, reverse=True)
    rows = {r.doc_id: r for r in fingerprint.fingerprints(documents).collect()}
    assert set(rows) == set(ids)
    for i, after in zip(ids, ids[1:] + ids[:1]):
        t, other = texts[i], texts[after]
        edited = t[: len(t) - len(t) // 2] + other[: len(t) // 2]
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (plain_hex(t), plain_hex(edited))
        assert abs(r.near_edited - plain_likeness(t, edited)) < 1e-9 and abs(r.near_next - plain_likeness(t, other)) < 1e-9


def test_ranges_change_nothing(spark, documents):
    base = documents.select("doc_id", F.lit(0).alias("tie"))
    want = {r.doc_id: r.next.doc_id for r in fingerprint.following(base, ["doc_id"], 1).where("next is not null").collect()}
    for n in (2, 7, 500):
        got = {r.doc_id: r.next.doc_id for r in fingerprint.following(base, ["doc_id"], n).where("next is not null").collect()}
        ids = sorted(want, reverse=True)
        assert all(got[a] == b for a, b in zip(ids, ids[1:]))


def test_more_sentences_than_a_small_lane_holds(spark):
    n = (1 << 20) + 7
    docs = spark.createDataFrame([(1, "a. " * n), (2, "a. " * n + "b.")], "doc_id long, text string")
    by = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    assert by[1].fingerprint.endswith(f"{n:016x}") and 0.99 < by[1].near_next < 1.0
