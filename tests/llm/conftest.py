import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, node long, component_id long, spans string, rank int, length int, next string, range int, vector string, digest string, row long"
PROSE = "the erth of ing ou and thor eat on es nd re"


def prose(n, seed=0):
    words = PROSE.split()
    return " ".join(words[(i * i + 7 * i * seed + seed) % len(words)] + ("." if i % 9 == 8 else "") for i in range(n))


def row(doc_id, text, lang="en"):
    return (doc_id, text, lang, "src0", None if text is None else len(text)) + (1, 2, 3, "x", 4, 5, "y", 6, "z", "w", 7)


#: Nulls, empty and blank texts, one very long text, ties, repeated rows, extra columns.
EDGE = [
    row(1, None), row(2, ""), row(3, " \n\t "), row(4, prose(120)), row(5, prose(120)), row(5, prose(120)), row(6, prose(40_000, 3)), row(None, prose(30, 1)), row(None, None),
    row(7, "a"), row(8, "é" * 5000), row(9, "x" * 200_000, None), row(10, prose(60, 2) + " " + prose(120)), row(11, "one two"),
]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.collect()}
