"""Chunks of documents by sentences, blocks or code boundaries, within a token budget.

A document is cut at the largest boundaries that make pieces fit (``boundaries``: blocks of
code, paragraphs, lines, sentences, words, characters), pieces are
joined again as far as the budget goes, and following chunks overlap by whole
pieces. Chunks are trimmed, not empty, parts of the text and within the budget
as the sizer counts; exact boundaries of other splitters aren't reproduced.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from tidewell.operators.boundaries import Block, character_ends, code_blocks, python_blocks, sentence_ends, word_ends

Sizer = Callable[[str], int]


def word_count(text: str) -> int:
    """Tokens as white-space words, the default sizer."""
    return len(text.split())


MARKDOWN = (".md", ".markdown", ".mdx")
#: Languages that are cut at their blocks, by extension: the family whose strings and comments they share.
CODE = {".py": "python", ".rs": "rust", ".go": "go", ".java": "java"} | dict.fromkeys((".js", ".mjs", ".cjs", ".ts", ".tsx"), "js") | dict.fromkeys(
    (".c", ".h", ".cpp", ".cc", ".cxx", ".hpp", ".hxx"), "c"
)
Cut = Callable[[str, int, int], list[int]]


def _after(pattern: str, flags: int = 0) -> Cut:
    found = re.compile(pattern, flags)
    return lambda text, a, z: [m.end() for m in found.finditer(text, a, z)]


#: Boundaries from coarse to fine: places within a part of a text.
TEXT_CUTS: list[Cut] = [_after(r"\n\s*\n"), _after(r"\n"), sentence_ends, _after(r"(?<=[,;:，；、])\s*"), _after(r"\s+"), word_ends, character_ends]
MARKDOWN_CUTS: list[Cut] = [_after(p, re.M) for p in (r"\n(?=# )", r"\n(?=##+ )", r"\n\s*\n", r"\n(?=[-*+] |\d+\. )")] + TEXT_CUTS[1:]


def extension(name: str) -> str:
    dot = name.rfind(".")
    return name[dot:].lower() if dot >= 0 else ""


def effective_size(size: int, overlap: int, model: tuple[int, int] = (0, 0), context: int = 2048) -> tuple[int, int]:
    """Budget and overlap: 0 takes the model's, else 1024 and 100; both are clamped."""
    n = min(max(size or model[0] or 1024, 1), context)
    return n, min(max(overlap or model[1] or 100, 0), n - 1)


def _spans(text: str, a: int, z: int, cut: Cut) -> list[tuple[int, int]]:
    ends = [e for e in cut(text, a, z) if a < e < z]
    return [(b, e) for b, e in zip([a, *ends], [*ends, z], strict=True) if text[b:e].strip()]


def _fit(text: str, a: int, z: int, cuts: list[Cut], sizer: Sizer, size: int) -> Iterator[tuple[int, int]]:
    """Pieces of at most ``size`` tokens, cut no finer than needed."""
    if sizer(text[a:z].strip()) <= size or not cuts:
        yield a, z
        return
    for b, e in _spans(text, a, z, cuts[0]) or [(a, z)]:
        yield from _fit(text, b, e, cuts[1:], sizer, size)


def _fit_blocks(text: str, a: int, z: int, blocks: list[Block], sizer: Sizer, size: int) -> Iterator[tuple[int, int]]:
    """The same along nested blocks: one that fits stays whole, else its inner blocks are looked at."""
    if not blocks:
        yield from _fit(text, a, z, TEXT_CUTS, sizer, size)
    elif sizer(text[a:z].strip()) <= size:
        yield a, z
    else:
        at = a
        for b in blocks:
            if text[at : b.start].strip():  # what stands before the first inner block, such as a head
                yield from _fit(text, at, b.start, TEXT_CUTS, sizer, size)
            yield from _fit_blocks(text, b.start, b.end, b.inner, sizer, size)
            at = b.end
        if text[at:z].strip():
            yield from _fit(text, at, z, TEXT_CUTS, sizer, size)


def _code_pieces(text: str, ext: str, sizer: Sizer, size: int) -> list[tuple[int, int]]:
    blocks = python_blocks(text) if CODE[ext] == "python" else code_blocks(text, CODE[ext])
    return list(_fit_blocks(text, 0, len(text), blocks, sizer, size))


def chunk_text(name: str, text: str, size: int, overlap: int, sizer: Sizer = word_count) -> list[str]:
    """Chunks of one document; code that can't be parsed is cut as text."""
    text, ext = text.strip(), extension(name)
    size = max(size, 1)
    overlap = min(max(overlap, 0), size - 1)
    if not text:
        return []
    try:
        if ext in CODE:
            parts = _code_pieces(text, ext, sizer, size)
        else:
            parts = list(_fit(text, 0, len(text), MARKDOWN_CUTS if ext in MARKDOWN else TEXT_CUTS, sizer, size))
    except (SyntaxError, ValueError, RecursionError):
        parts = list(_fit(text, 0, len(text), TEXT_CUTS, sizer, size))
    sizes = [sizer(text[a:z].strip()) for a, z in parts]
    out, i = [], 0
    while i < len(parts):
        j, total = i + 1, sizes[i]
        while j < len(parts) and total + sizes[j] <= size and sizer(text[parts[i][0] : parts[j][1]].strip()) <= size:
            total += sizes[j]
            j += 1
        if chunk := text[parts[i][0] : parts[j - 1][1]].strip():
            out.append(chunk)
        if j == len(parts):
            break
        back, held = j, 0
        while back - 1 > i and held + sizes[back - 1] <= overlap:
            back -= 1
            held += sizes[back]
        i = back
    return out


#: Documents and characters whose chunks a task holds at once.
MOST_DOCS, MOST_CHARS = 512, 4 << 20


def _bounded(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The same rows in parts of so many documents and, but for a single one, characters; an empty batch is one part."""
    at, held = 0, 0
    for i, text in enumerate(batch["text"]):
        n = len(text or "")
        if i > at and (i - at >= MOST_DOCS or held + n > MOST_CHARS):
            yield batch.iloc[at:i]
            at, held = i, 0
        held += n
    yield batch.iloc[at:]


def chunk_documents(docs: DataFrame, size: int = 1024, overlap: int = 100, sizer: Sizer = word_count, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, doc_name, chunk_index, chunk_text, error)`` of ``(doc_id, name, text)``, and the columns ``carry`` of each document.

    A document that fails has one row with its error and no text; the others go on.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (part for whole in batches for part in _bounded(whole)):
            rows = []
            for doc, name, text, *more in zip(b["doc_id"], b["name"], b["text"], *(b[c] for c in carry), strict=True):
                try:
                    rows += [(doc, name, i, c, None, *more) for i, c in enumerate(chunk_text(name or "", text or "", size, overlap, sizer))]
                except MemoryError:  # the worker's fault and not the document's: the task runs again, or the job says so
                    raise
                except Exception as e:  # noqa: BLE001 - one document must not stop the rest
                    rows.append((doc, name, None, None, f"{type(e).__name__}: {e}", *more))
            yield pd.DataFrame(rows, columns=["doc_id", "doc_name", "chunk_index", "chunk_text", "error", *carry]).astype({"chunk_index": "Int64"})

    kind = {c: docs.schema[c].dataType.simpleString() for c in ("doc_id", *carry)}
    schema = f"doc_id {kind['doc_id']}, doc_name string, chunk_index long, chunk_text string, error string" + "".join(f", {c} {kind[c]}" for c in carry)
    return docs.select("doc_id", "name", "text", *carry).mapInPandas(run, schema)
