from pathlib import Path

import pytest

from tests.oracle import TABLES, assert_same, connect
from tidewell.plans import catalogue, stored  # noqa: F401  registers its queries with those of catalogue


@pytest.fixture()
def with_tables(spark, sf_dir, tmp_path):
    """A function that gives a folder of all tables, some of them replaced."""

    def put(**own):
        for t in TABLES:
            (tmp_path / f"{t}.parquet").symlink_to(Path(sf_dir, f"{t}.parquet"))
        for t, df in own.items():
            (tmp_path / f"{t}.parquet").unlink()
            df.toPandas().to_parquet(tmp_path / f"{t}.parquet")
        return str(tmp_path)

    return put


def same(spark, name, at):
    assert_same(catalogue.QUERIES[name](spark, at), connect(at).sql(catalogue.ORACLES[name]))


def test_pooling_of_vectors_without_a_masked_token(spark, with_tables):
    """No token in the mask: mean 0, no first, no last, but four rows; what rounds to zero keeps its sign."""
    rows = [(0, [-0.5] * 64), (1, [0.25] * 64), (2, [0.1, -1e-7, 1e-7, -0.0] * 16), (3, [-0.1, 0.3, 0.0, 0.2] * 15 + [0.0, 0.1, 0.1, 0.1]), (4, None)]
    same(spark, "pooling_windows", with_tables(embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<double>")))


def test_a_server_of_several_slices_is_one_row(spark, sf_dir, with_tables):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    names = spark.range(12_000).selectExpr("id * 50 as p_partkey", "concat('part ', id) as p_name").join(part.drop("p_partkey", "p_name").limit(1))
    at = with_tables(part=part.where("p_partkey % 50 <> 0").unionByName(names.select(*part.columns)))
    assert catalogue.QUERIES["tools_by_server"](spark, at).where("n = 12000").count() == 1
    same(spark, "tools_by_server", at)


def test_catalogs_of_skills_are_not_broadcast(spark, sf_dir):
    for name in ("stale_exports", "verified_exports"):
        assert "BroadcastHashJoin" not in catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_a_base_of_rows_that_share_ids_and_of_texts_without_words(spark, with_tables):
    """Each row, and each of its labels, is a document of its own; no text stays none, and one without words misses nothing in the index."""
    texts = [(1, "a", "en"), (1, "b", "de"), (2, "c", "de"), (2, "c", "de"), (-3, "d", "fr"), (4, None, "en"), (5, None, "en"), (6, "", "es"), (7, " \n", "es"), (8, "　\x1c\x85", "fr"), (9, "x", None)]
    docs = spark.createDataFrame([(i, t, lang, f"src{i}", 0) for i, t, lang in texts], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(2, 0, 1), (-3, 1, 0), (-3, 1, 0), (-3, 0, 1), (5, 1, 1), (7, 0, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")
    same(spark, "base_update", with_tables(documents=docs, labels=labels))
