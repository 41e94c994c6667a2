"""Hybrid document search: cosine and keyword channels, merged and ranked.

Every limit has a total order that ends in (doc_id, chunk_index), so results
don't depend on the partitions. A limit after an order is one
TakeOrderedAndProject: each task keeps its best rows and only these meet.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.numbers import as_score
from tidewell.functions.text import fold_ascii

KEY = ["doc_id", "chunk_index"]


@dataclass(frozen=True)
class Settings:
    """What a search weighs; values out of range are clamped."""

    vector_weight: float = 0.9
    keyword_weight: float = 0.1
    max_results: int = 20
    score_threshold: float = 0.65

    def clamped(self) -> Settings:
        one = lambda x: min(max(x, 0.0), 1.0)
        return replace(self, vector_weight=one(self.vector_weight), keyword_weight=one(self.keyword_weight), max_results=max(1, self.max_results), score_threshold=one(self.score_threshold))


def query_terms(query: str) -> list[str]:
    """Lower-cased words of a query, repeats included."""
    return [w.lower() for w in query.split()]


#: Digits to which cosines are compared, so that equal vectors tie whatever block they are in.
DIGITS = 12
#: Bytes of doubles that a block of vectors has in a task.
BLOCK = 16 << 20
#: Bytes of scores that a task holds at once, but for a single query's.
SCORES = 8 << 20
_HITS = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("chunk_index", pa.int64()), ("score", pa.float64())])


def _matrix(column) -> np.ndarray:
    """Unit vectors of an Arrow list column; zero vectors stay zero. Null vectors and entries count as zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    dim = int(lengths.max(initial=0))
    out = np.zeros((len(column), dim))
    out[np.arange(dim) < lengths[:, None]] = pc.fill_null(column.flatten().cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def nearest(chunks: DataFrame, vector: list[float], k: int, keys: list[str] = KEY) -> DataFrame:
    """The ``k`` chunks of smallest cosine distance, with ``distance``; zero and null vectors are at distance 1, ties go by key.

    Vectors are scanned as blocks of numbers, and each task keeps ``k`` rows. All columns given go
    through the scan, so name those that are needed.
    """
    fields = [*chunks.schema.fields, T.StructField("distance", T.DoubleType())]
    at = chunks.columns.index("embedding")
    order = [("distance", "ascending"), *((c, "ascending") for c in keys)]

    def best(batches):
        q = np.asarray(vector, dtype=np.float64)
        q = q / max(np.linalg.norm(q), 1e-300)
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _matrix(batch.column(at))
            distance = 1.0 - (np.round(m @ q, DIGITS) if m.shape[1] == len(q) else np.zeros(len(m)))
            n = min(k, len(distance))
            some = np.flatnonzero(distance <= np.partition(distance, n - 1)[n - 1])  # all ties of the last place
            found = pa.Table.from_batches([batch]).append_column("distance", pa.array(distance)).take(pa.array(some))
            kept = found if kept is None else pa.concat_tables([kept, found])
            kept = kept.take(pc.sort_indices(kept, order)[:k])
        if kept is not None:
            yield from kept.combine_chunks().to_batches()

    return chunks.mapInArrow(best, T.StructType(fields)).orderBy("distance", *keys).limit(k)


def _best(ids: np.ndarray, q: np.ndarray, doc: np.ndarray, chunk: np.ndarray, m: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """The ``k`` best rows of a block for each query, ties by key."""
    order = np.lexsort((chunk, doc))
    doc, chunk, m, n = doc[order], chunk[order], m[order], min(k, len(m))
    out: dict[str, list] = {c: [np.empty(0, dtype=np.int64)] * (c != "score") + [np.empty(0)] * (c == "score") for c in _HITS.names}
    step = max(1, SCORES // (8 * max(len(m), 1)))
    for at in range(0, len(ids) if n else 0, step):
        score = q[at : at + step] @ m.T
        np.round(score, DIGITS, out=score)
        least = np.partition(score, len(m) - n, axis=1)[:, len(m) - n]
        for j, query in enumerate(ids[at : at + step]):
            row = np.flatnonzero(score[j] >= least[j])  # all ties of the last place, in key order
            row = row[np.argsort(-score[j, row], kind="stable")[:n]]
            for name, value in zip(_HITS.names, (np.full(len(row), query), doc[row], chunk[row], score[j, row]), strict=True):
                out[name].append(value)
    return {c: np.concatenate(v) for c, v in out.items()}


def _merged(parts: list[dict[str, np.ndarray]], k: int) -> dict[str, np.ndarray]:
    """The ``k`` best of each query among several blocks' hits."""
    all_ = {c: np.concatenate([p[c] for p in parts]) for c in _HITS.names}
    order = np.lexsort((all_["chunk_index"], all_["doc_id"], -all_["score"], all_["query_id"]))
    ids = all_["query_id"][order]
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.empty(0, dtype=np.int64)
    rank = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))
    return {c: v[order][rank < k] for c, v in all_.items()}


def _near_few(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Hits of a few queries, which all tasks get: each keeps ``k`` a query before anything is exchanged."""
    rows = queries.toArrow()
    held = chunks.sparkSession.sparkContext.broadcast((rows["query_id"].to_numpy(), _matrix(rows["vector"])))

    def best(batches):
        ids, q = held.value
        kept = None
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            hits = _best(ids, q, batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2)), k)
            kept = _merged([kept, hits], k) if kept else hits
        if kept:
            yield pa.RecordBatch.from_pydict(kept, schema=_HITS)

    return chunks.mapInArrow(best, "query_id long, doc_id long, chunk_index long, score double")


def _near_many(queries: DataFrame, chunks: DataFrame, k: int, rows: int, n_queries: int) -> DataFrame:
    """Hits on a grid: each block of queries meets each block of chunks once, in a cell that holds only these two."""
    q_blocks, v_blocks = -(-n_queries // rows), max(1, -(-chunks.count() // rows))
    block = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(block(q_blocks, "query_id").alias("qb"), every(v_blocks).alias("vb"), "query_id", "vector")
    there = chunks.select(every(q_blocks).alias("qb"), block(v_blocks, "doc_id", "chunk_index", "embedding").alias("vb"), *chunks.columns)

    def cell(q: pa.Table, v: pa.Table) -> pa.Table:
        hits = _best(q["query_id"].to_numpy(), _matrix(q["vector"]), v["doc_id"].to_numpy(), v["chunk_index"].to_numpy(), _matrix(v["embedding"]), k)
        return pa.Table.from_pydict(hits, schema=_HITS)

    return asked.groupBy("qb", "vb").cogroup(there.groupBy("qb", "vb")).applyInArrow(cell, "query_id long, doc_id long, chunk_index long, score double")


def nearest_to_each(queries: DataFrame, chunks: DataFrame, k: int, max_queries: int = 4096, rows: int | None = None) -> DataFrame:
    """``k`` nearest chunks of each query ``(query_id, vector)``: ``(query_id, doc_id, chunk_index, score, rank)``.

    The chunks are scanned once for any number of queries. The queries are counted: up to
    ``max_queries`` are sent to all tasks. More of them are dealt to blocks, as are the chunks,
    and the blocks meet on a grid; ``rows`` of a block come from its vectors' bytes. Each block keeps
    ``k`` a query, so what meets in the end is small. Scores are compared to 12 digits, ties by key.
    """
    asked, there = queries.select("query_id", "vector"), chunks.select("doc_id", "chunk_index", "embedding")
    n = asked.count()
    if n <= max_queries:
        out = _near_few(asked, there, k)
    else:
        dim = asked.agg(F.max(F.size("vector"))).first()[0]
        out = _near_many(asked, there, k, rows or max(256, BLOCK // (8 * max(dim, 1))), n)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *KEY)
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def keyword_hits(chunks: DataFrame, query: str, k: int) -> DataFrame:
    """Chunks with any of the query's words; ``%`` and ``_`` in a word are live."""
    terms = query_terms(query)
    if not terms:
        return chunks.limit(0)
    low = F.lower("chunk_text")
    hit = F.lit(False)
    for t in dict.fromkeys(terms):
        live = any(c in t for c in "%_\\")
        hit = hit | (low.like("%" + t.replace("\\", "\\\\") + "%") if live else F.contains(low, F.lit(t)))
    return chunks.where(hit).orderBy(*KEY).limit(k)


def match_ratio(text: Column, query: str) -> Column:
    """Share of the query's words, repeats included, that a text holds as they are."""
    terms = query_terms(query)
    found = sum((F.contains(F.lower(text), F.lit(t)).cast("int") for t in terms), F.lit(0))
    return found / F.lit(float(max(len(terms), 1)))


def any_tag(tags: Column, wanted: list[str]) -> Column:
    """Whether a tag equals a wanted one but for ASCII case."""
    low = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in wanted]
    return F.coalesce(F.exists(tags, lambda t: fold_ascii(t).isin(low)), F.lit(False))


def hybrid_search(
    chunks: DataFrame, query: str, vector: list[float], settings: Settings = Settings(), tags: list[str] | None = None,
    titles: DataFrame | None = None, prefilter: bool = False,
) -> DataFrame:
    """``(doc_id, doc_name, title, snippet, score)`` by falling score.

    Each channel with a weight gives its first candidates, twice the results
    or four times with tags; a chunk that only one channel has counts 0 in the
    other. Tags are looked at after that cut, unless ``prefilter``.
    """
    s = settings.clamped()
    wanted = [t for t in tags or [] if t]
    if wanted and prefilter:
        chunks = chunks.where(any_tag(F.col("tags"), wanted))
    fetch = s.max_results * (4 if wanted else 2)
    about = ["doc_name", "chunk_text", "tags"]
    none = chunks.select(*KEY, *about).limit(0)
    by_vector = none.withColumn("vs", F.lit(0.0))
    if s.vector_weight > 0:  # the scan of all vectors reads no text; texts of the few winners are fetched by key
        near = nearest(chunks.select(*KEY, "embedding"), vector, fetch).select(*KEY, (F.lit(1.0) - F.col("distance")).alias("cosine"))
        by_vector = chunks.select(*KEY, *about).join(F.broadcast(near), KEY).select(*KEY, *about, as_score(F.col("cosine")).alias("vs"))
    by_word = keyword_hits(chunks, query, fetch).select(*KEY, *about, match_ratio(F.col("chunk_text"), query).alias("ks")) if s.keyword_weight > 0 else none.withColumn("ks", F.lit(0.0))
    both = by_vector.alias("v").join(by_word.alias("k"), KEY, "full_outer").select(
        *KEY, *(F.coalesce(f"v.{c}", f"k.{c}").alias(c) for c in about), F.coalesce("vs", F.lit(0.0)).alias("vs"), F.coalesce("ks", F.lit(0.0)).alias("ks")
    )
    if wanted:
        both = both.where(any_tag(F.col("tags"), wanted))
    scored = both.withColumn("score", F.lit(s.vector_weight) * F.col("vs") + F.lit(s.keyword_weight) * F.col("ks"))
    best = scored.where(~F.isnan("score") & (F.col("score") >= s.score_threshold)).orderBy(F.desc("score"), *KEY).limit(s.max_results)
    title = F.col("doc_name")
    if titles is not None:
        best = best.join(titles.select("doc_id", "title"), "doc_id", "left")
        title = F.coalesce(F.nullif("title", F.lit("")), "doc_name")
    return best.select("doc_id", "doc_name", title.alias("title"), F.col("chunk_text").alias("snippet"), "score")
