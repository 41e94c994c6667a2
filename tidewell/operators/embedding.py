"""Embeddings by a model that is given, and the indexing pipeline around it.

A model is any object with ``dim``, ``batch`` and ``embed(list of texts)``; it
is loaded once a task. The hashing model shipped here is deterministic and of
unit norm but knows nothing of meaning.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.chunking import Sizer, chunk_documents, word_count
from tidewell.plans.mutations import replace_matching


class Embedder(Protocol):
    dim: int
    batch: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed hashes of words and their beginnings, normalised; an empty text is the zero vector."""

    def __init__(self, dim: int = 384, batch: int = 32, context: int = 2048):
        self.dim, self.batch, self.context = dim, batch, context

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in re.findall(r"\w+", text.lower())[: self.context]:
                for piece, weight in ((word, 1.0), (word[:4], 0.5)):
                    h = zlib.crc32(piece.encode())
                    row[h % self.dim] += weight if h & 0x80000000 else -weight
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed_chunks(chunks: DataFrame, make: Callable[[], Embedder] = HashingEmbedder, prefix: str = "", text: str = "chunk_text") -> DataFrame:
    """Adds ``embedding`` from prefix and text; the stored text has no prefix."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for part in parts:
            texts = [prefix + (t or "") for t in part]
            found = [v for i in range(0, len(texts), model.batch) for v in model.embed(texts[i : i + model.batch])]
            yield pd.Series(found, index=part.index)

    return chunks.withColumn("embedding", run(text))


def embed_query(query: str, make: Callable[[], Embedder] = HashingEmbedder, prefix: str = "") -> list[float]:
    """One vector for a search; the keyword channel uses the query as it is."""
    return make().embed([prefix + query])[0].tolist()


def index_documents(
    docs: DataFrame, size: int = 512, overlap: int = 100, make: Callable[[], Embedder] = HashingEmbedder, prefix: str = "", sizer: Sizer = word_count,
    hold: Callable[[DataFrame], DataFrame] = lambda parts: parts,
) -> tuple[DataFrame, DataFrame]:
    """Chunk and embed ``(doc_id, name, text, tags)``: the chunk table, and ``(doc_id, error)`` of those that failed.

    Each document is read once; ``hold`` may write the chunks, so that those who ask for both don't chunk twice.
    """
    parts = hold(chunk_documents(docs, size, overlap, sizer, ("tags",)))
    good = parts.where("error is null")
    keyed = good.withColumn("id", F.sha2(F.concat_ws("/", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")), 256))
    table = embed_chunks(keyed, make, prefix).select("id", "doc_id", "doc_name", "chunk_index", "chunk_text", "embedding", "tags")
    return table, parts.where("error is not null").select("doc_id", "error")


def index_results(docs: DataFrame, table: DataFrame, failed: DataFrame) -> DataFrame:
    """``(doc_id, chunk_count, error)`` of every document: how many chunks it has, or why it has none."""
    n = table.groupBy("doc_id").agg(F.count("*").alias("chunk_count"))
    return docs.select("doc_id").join(n, "doc_id", "left").join(failed, "doc_id", "left").select("doc_id", F.coalesce("chunk_count", F.lit(0).cast("long")).alias("chunk_count"), "error")


def reindex(chunks: DataFrame, docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """The chunk table with the given documents' chunks replaced, and what failed; failed ones keep their old chunks."""
    new, failed = index_documents(docs, **options)
    done = docs.select("doc_id").join(failed, "doc_id", "left_anti")
    kept = chunks.join(done, "doc_id", "left_anti").select(*chunks.columns)
    return kept.unionByName(new.select(*chunks.columns)), failed


def replace_chunks(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """New chunks instead of all old ones of their documents."""
    return replace_matching(chunks, new, ["doc_id"])
