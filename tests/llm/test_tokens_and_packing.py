import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewell.llm import packing, tokens

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LIBRARY, WORD_LIBRARY = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)
ODD = ["", " ", "a" * 3000, "  \n\n  " * 200, "x  y　z " * 100, "<|endoftext|> a<|endoftext|>b" * 30, "日本語 テキスト。" * 90, "é́ ﷺ 𝒳 " * 60, " " * 900 + "a", "It's ISN'T 12345 a-b..!! 'll", "a\x1cb c\x85d", "Å ΑΣ İ ſ K"]


@pytest.mark.parametrize("text", ODD)
def test_counts_of_odd_texts(text):
    want = len(LIBRARY.encode(text, add_special_tokens=False))
    for chunk, overlap in ((32_768, 256), (100, 8), (33, 1)):
        assert tokens.count_tokens(tokens.encoder(BYTES), text, chunk, overlap) == want


@given(st.text(alphabet="ab é'sll\n\t1.<|>日", max_size=300))
@settings(max_examples=150, deadline=None)
def test_counts_of_any_text(text):
    assert tokens.count_tokens(tokens.encoder(BYTES), text, 40, 4) == len(LIBRARY.encode(text, add_special_tokens=False))


@given(st.text(alphabet="abZ é'sll\n\t1.<|>日İ", max_size=200))
@settings(max_examples=150, deadline=None)
def test_word_ids_of_any_text(text):
    assert np.frombuffer(packing.word_encoder(WORDS).ids(text), "<u4").tolist() == WORD_LIBRARY.encode(text, add_special_tokens=False).ids


def test_token_counts(documents, texts):
    rows = tokens.token_counts(documents, BYTES, chunk=3000, overlap=64).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(LIBRARY.encode(texts[r.doc_id], add_special_tokens=False))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)


def test_count_edges(edge, nothing):
    rows = tokens.token_counts(edge, BYTES).collect()
    assert len(rows) == edge.count() and {r.doc_id: r.n_tokens for r in rows}[1] == 0
    assert tokens.token_counts(nothing, BYTES).count() == 0


def check_packing(rows, docs, size):
    """Every piece is right, no sequence overflows or has a gap."""
    got, places = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= size
    for doc, text in docs.items():
        ids = WORD_LIBRARY.encode(text or "", add_special_tokens=False).ids + [1]
        parts = sorted(got[doc], key=lambda r: r.piece)
        assert [(r.start, r.length) for r in parts] == [(i, min(size, len(ids) - i)) for i in range(0, len(ids), size)]
        for r in parts:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes())
    return len(places)


@pytest.mark.parametrize("size", [4096, 257])
def test_packing(documents, texts, size):
    rows = packing.pack(documents, WORDS, size).collect()
    sequences = check_packing(rows, texts, size)
    assert sequences <= 1.02 * sum(r.length for r in rows) / size + 1


def test_packing_edges(edge, nothing):
    rows = packing.pack(edge, WORDS, 512).collect()
    assert sum(r.doc_id == 1 for r in rows) == 1 and sum(r.doc_id == 5 and r.piece == 0 for r in rows) == 2
    check_packing(rows, {}, 512)
    assert packing.pack(nothing, WORDS).count() == 0


@pytest.mark.parametrize("histogram", [{}, {1: 5000}, {4096: 7}, {2049: 50}, {4095: 3, 1: 3}, {i: i % 5 for i in range(1, 4097)}, {1365: 3000, 1366: 3000}])
def test_plans_use_every_rank_once(histogram):
    rows = packing.plan(histogram)
    ranks, fill = defaultdict(set), defaultdict(int)
    for length, a, z, n, sequence, offset in rows.tolist():
        for r in range(a, z):
            copy, nth = divmod(r - a, n)
            assert r not in ranks[length]
            ranks[length].add(r)
            fill[sequence + nth] = max(fill[sequence + nth], offset + (copy + 1) * length)
    assert {k: len(v) for k, v in ranks.items()} == {k: v for k, v in histogram.items() if v}
    assert all(v <= 4096 for v in fill.values())
