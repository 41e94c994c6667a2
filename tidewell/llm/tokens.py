"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text of more than ``chunk`` characters is encoded in chunks that overlap.
Both encodings of an overlap are cut at a boundary that they share and that
is proven stable: a non-space character followed by white space. No piece of
the splitting pattern runs from the one into the other and no merge crosses
pieces, so the tokens on each side do not depend on the text beyond. Where an
overlap holds no such boundary, it is widened until it does or the text ends.

The vocabulary is read from the merges of the tokenizer's file. Its compiled
ranks give the same pieces for text below U+0250, where all Unicode versions
agree on letters and digits; any other text goes to the ``tokenizers`` library
itself, in the same chunks.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewell.llm.common import map_columns

#: White space by which the splitting pattern cuts, below U+0250.
STABLE = re.compile(r"\S(?=[ \t\n\r\x0b\x0c])")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """A byte-level tokenizer file: ids and where their characters end."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocab, of = spec["model"]["vocab"], byte_alphabet()
        ranks = {bytes(of[c] for c in t): i for t, i in vocab.items() if t not in added}
        self.special = set(added)
        self.ranks = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self.size = np.zeros(max(self.ranks.n_vocab, len(vocab) + len(added)) + 1, dtype=np.int64)
        for token, i in ranks.items():
            self.size[i] = len(token)
        for token, i in added.items():
            self.size[i] = len(token.encode())

    def simple(self, text: str) -> bool:
        return text.isascii() or max(text) < "ɐ"

    def count(self, text: str) -> int:
        if self.simple(text):
            return len(self.ranks.encode(text, allowed_special=self.special))
        return len(self.library.encode(text, add_special_tokens=False))

    def ends(self, text: str) -> np.ndarray:
        """Byte ends of the tokens of one chunk, in order."""
        if self.simple(text):
            return np.cumsum(self.size[self.ranks.encode(text, allowed_special=self.special)])
        ids = self.library.encode(text, add_special_tokens=False).ids
        return np.cumsum(self.size[ids])


def stable_cuts(text: str, low: int, high: int) -> list[int]:
    """Stable boundaries between two places of a text, as code points."""
    return [m.end() for m in STABLE.finditer(text, max(low - 1, 0), min(high + 1, len(text))) if low <= m.end() <= high]


def count_tokens(encoder: Encoder, text: str, chunk: int = 32_768, overlap: int = 256) -> int:
    """Tokens of the whole text, the same as if it were encoded at once."""
    if len(text) <= chunk:
        return encoder.count(text)
    total, start = 0, 0
    while True:
        stop = min(start + chunk, len(text))
        if stop == len(text):
            return total + encoder.count(text[start:])
        wide = overlap
        while True:
            stop = min(start + chunk + (wide - overlap), len(text))
            if stop == len(text):
                return total + encoder.count(text[start:])
            low = max(start + 1, stop - wide)
            left = encoder.ends(text[start:stop])
            right = encoder.ends(text[low : stop + wide])
            cut = _splice(text, start, low, stop, left, right)
            if cut:
                at, tokens = cut
                total, start = total + tokens, at
                break
            wide *= 2


def _splice(text, start, low, stop, left, right) -> tuple[int, int] | None:
    """The first stable boundary that both encodings have, and the tokens before it."""
    own, other = set(left.tolist()), set(right.tolist())
    base = len(text[start:low].encode())
    for at in stable_cuts(text, low, stop - 1):
        far = len(text[low:at].encode())
        if base + far in own and far in other:
            return at, int(np.searchsorted(left, base + far, side="right"))
    return None


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_counts(docs: DataFrame, path: str, limit: int = 512, chunk: int = 32_768, overlap: int = 256) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``, one row per input row.

    A null text counts as empty: no bytes, no tokens. Very long texts are counted whole, in
    overlapping chunks. Repeated rows come back alike, rows without an id keep a null one; other columns
    aren't read. An empty table gives no rows.
    """

    def run(ids, texts):
        found = encoder(path)
        texts = [t or "" for t in texts]
        n = [count_tokens(found, t, chunk, overlap) for t in texts]
        return {"doc_id": ids, "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return map_columns(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id", "text"],
        "doc_id long, n_bytes long, n_tokens long, over_limit boolean", run,
    )
