"""Token batches as a model takes them: ids with marks at both ends, cut to the context, padded, with a mask.

Ids come from a tokenizer file that the caller names (``tokenizers`` reads it, once a
task). A text without ids has none at all, not even the marks. Within a batch rows are padded on
the right to the longest one; the mask is 1 on ids and 0 on padding, and is what the pooling
functions of ``tidewell.functions.numbers`` take.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tokens:
    """How texts become ids: the tokenizer's file, ids of the marks (None: no such mark), most ids, the id that pads."""

    path: str
    begin: int | None = None
    end: int | None = None
    context: int = 2048
    pad: int = 0

    def ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, marks included, at most ``context`` of them: the rest is cut off, an end mark with it."""
        out = []
        for found in _reader(self.path).encode_batch_fast(texts, add_special_tokens=False):
            own = found.ids
            if own:
                own = [self.begin] * (self.begin is not None) + own[: self.context] + [self.end] * (self.end is not None)
            out.append(own[: self.context])
        return out

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of a batch, ``(rows, longest)`` both; at least one column."""
        own = self.ids(texts)
        lengths = np.array([len(x) for x in own], dtype=np.int64)
        width = max(1, int(lengths.max(initial=0)))
        mask = (np.arange(width) < lengths[:, None]).astype(np.int8)
        ids = np.full((len(own), width), self.pad, dtype=np.int64)
        ids[mask == 1] = [i for x in own for i in x]
        return ids, mask


@lru_cache(maxsize=4)
def _reader(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def by_length(tokens: Tokens, texts: list[str], batch: int) -> Iterator[np.ndarray]:
    """Places of the texts of each batch; texts of like length share one, so that little is padded."""
    order = np.argsort([len(t) for t in texts], kind="stable")
    for at in range(0, len(order), batch):
        yield order[at : at + batch]


def token_batches(chunks: DataFrame, tokens: Tokens, batch: int = 32, text: str = "chunk_text") -> DataFrame:
    """Adds ``ids`` and ``mask`` to the rows, padded to the longest row of a batch of at most ``batch`` rows; a null text has neither ids nor a mask of 1."""

    @F.pandas_udf("struct<ids: array<int>, mask: array<int>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = [t or "" for t in part]
            ids, masks = [None] * len(texts), [None] * len(texts)
            for own in by_length(tokens, texts, batch):
                x, m = tokens.batch([texts[i] for i in own])
                for row, i in enumerate(own):
                    ids[i], masks[i] = x[row], m[row]
            yield pd.DataFrame({"ids": ids, "mask": masks})

    return chunks.withColumn("_t", run(text)).select(*chunks.columns, "_t.ids", "_t.mask")


class TokenEmbedder:
    """An ``Embedder`` over token batches: each id has a vector made from a seed, and rows are pooled by their mask.

    ``mode`` is 1 for the mean, 2 for the first and 3 for the last id; vectors are of unit length, a text
    without ids has the zero vector. It knows no meaning; it shows where a model goes.
    """

    def __init__(self, tokens: Tokens, dim: int = 64, batch: int = 32, mode: int = 1, seed: int = 5):
        self.tokens, self.dim, self.batch, self.mode, self.seed = tokens, dim, batch, mode, seed

    def vectors(self, ids: np.ndarray) -> np.ndarray:
        """A vector for each id, the same wherever it stands: hashed signs of its bits."""
        x = ids[..., None].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.arange(self.dim, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(self.seed)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return (x >> np.uint64(11)).astype(np.float64) / 2.0**52 - 1.0

    def pooled(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        v, n = self.vectors(ids), mask.sum(axis=1)
        if self.mode == 1:
            out = (v * mask[..., None]).sum(axis=1) / (n[:, None] + 1e-9)
        else:
            at = np.zeros(len(ids), dtype=np.int64) if self.mode == 2 else np.maximum(n - 1, 0)
            out = v[np.arange(len(ids)), at] * (n > 0)[:, None]
        return out

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for own in by_length(self.tokens, texts, self.batch):
            v = self.pooled(*self.tokens.batch([texts[i] for i in own]))
            out[own] = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-12)
        return out
