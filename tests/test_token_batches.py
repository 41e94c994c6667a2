import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewell.functions import numbers as num
from tidewell.operators.embedding import embed_chunks
from tidewell.operators.token_batches import TokenEmbedder, Tokens, token_batches

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", "one", "a longer text of words, with é and 語", None, "x " * 90, "mid size text here", " \n "]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize(("begin", "end", "context"), [(None, None, 2048), (7, None, 2048), (7, 9, 2048), (None, 9, 8), (7, 9, 8), (7, 9, 1)])
def test_ids_are_the_librarys(library, begin, end, context):
    tokens = Tokens(PATH, begin, end, context, pad=3)
    texts = [t or "" for t in TEXTS]
    ids, mask = tokens.batch(texts)
    want = []
    for t in texts:
        own = library.encode(t, add_special_tokens=False).ids
        want.append(([begin] * (begin is not None) + own + [end] * (end is not None) if own else [])[:context])
    width = max(map(len, want))
    assert ids.shape == mask.shape == (len(texts), width)
    for row, m, w in zip(ids.tolist(), mask.tolist(), want, strict=True):
        assert row == w + [3] * (width - len(w)) and m == [1] * len(w) + [0] * (width - len(w))
    assert Tokens(PATH).batch([])[0].shape == (0, 1) and Tokens(PATH).batch([""])[1].tolist() == [[0]]


def test_batches_of_a_table(spark, library):
    tokens = Tokens(PATH, 7, 9, 16)
    df = spark.createDataFrame(list(enumerate(TEXTS * 5)), "id long, chunk_text string").repartition(2)
    rows = token_batches(df, tokens, 4).collect()
    assert len(rows) == 35
    for r in rows:
        own = library.encode(r.chunk_text or "", add_special_tokens=False).ids
        want = [7, *own, 9][:16] if own else []
        assert r.ids[: len(want)] == want and sum(r["mask"]) == len(want) and len(r.ids) == len(r["mask"]) <= 16 and not any(r.ids[len(want) :])
    assert token_batches(df.where("false"), tokens).count() == 0


@pytest.mark.parametrize("mode", [1, 2, 3])
def test_pooling_ignores_padding(spark, mode):
    """A text's vector is the same alone and in any batch, and that of the column functions over ids and mask."""
    model = TokenEmbedder(Tokens(PATH, 7, 9, 16), 6, 3, mode)
    texts = [t or "" for t in TEXTS]
    together = model.embed(texts)
    assert np.allclose(together, np.concatenate([model.embed([t]) for t in texts]), atol=1e-6)
    assert not together[0].any() and np.allclose(np.linalg.norm(together[[1, 2, 4, 5]], axis=1), 1, atol=1e-6)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, chunk_text string").coalesce(1)
    stored = {r.id: r.embedding for r in embed_chunks(df, lambda: model).collect()}
    assert np.allclose([stored[i] for i in range(len(texts))], together, atol=1e-6)
    table = spark.createDataFrame([(i, model.vectors(np.array(i)).tolist()) for i in {x for t in texts for x in model.tokens.ids([t])[0]} | {0}], "k int, v array<double>")
    long = token_batches(df, model.tokens, 3).select("id", "mask", F.posexplode("ids").alias("i", "k")).join(table, "k")
    pooled = long.groupBy("id", "mask").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("vs"))
    got = {r.id: r.p for r in pooled.select("id", num.l2_normalize(num.pool("vs", "mask", mode)).alias("p")).collect()}
    for i, t in enumerate(texts):
        if model.tokens.ids([t])[0]:
            assert np.allclose(got[i], together[i], atol=1e-6), i
        else:
            assert got[i] is None or not np.any(got[i])
