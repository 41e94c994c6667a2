"""Documents and their chunks: tags, titles, windows of tokens, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.text import bare_extension, doc_extension, fold_ascii, split_words, strip

CHUNK = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("doc_id", T.StringType()), T.StructField("doc_name", T.StringType()), T.StructField("chunk_index", T.LongType()),
    T.StructField("chunk_text", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType(), False)), T.StructField("tags", T.ArrayType(T.StringType(), True)),
])


def schema_guard(chunks: DataFrame, dim: int) -> bool:
    """Whether a stored chunk table must be indexed anew: columns missing or vectors of another length.

    One row of another length is enough, so the search for it stops at the first.
    """
    have = {f.name: f.dataType for f in chunks.schema}
    if any(f.name not in have for f in CHUNK) or not isinstance(have["embedding"], T.ArrayType) or not isinstance(have["tags"], T.ArrayType):
        return True
    return not chunks.where(F.size("embedding") != dim).limit(1).isEmpty()


def tag_stats(docs: DataFrame) -> DataFrame:
    """``(tag, file_count)``: documents of each non-empty tag; case counts, repeats within one don't."""
    return docs.select(F.explode(F.array_distinct(F.filter("tags", lambda t: t != ""))).alias("tag")).groupBy("tag").agg(F.count("*").alias("file_count"))


def tag_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(tag, change)``: what a change of documents adds to the statistics, from their rows as they were and as they are."""
    each = lambda docs, sign: docs.select(F.explode(F.array_distinct(F.filter("tags", lambda t: t != ""))).alias("tag"), F.lit(sign).alias("change"))
    return each(before, -1).unionByName(each(after, 1)).groupBy("tag").agg(F.sum("change").alias("change")).where("change <> 0")


def add_tag_deltas(stats: DataFrame, deltas: DataFrame) -> DataFrame:
    """The statistics after a change; a tag that no document has is gone."""
    both = stats.select("tag", "file_count").unionByName(deltas.select("tag", F.col("change").alias("file_count")))
    return both.groupBy("tag").agg(F.sum("file_count").alias("file_count")).where("file_count <> 0")


def search_tags(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Tags that hold any of the keys; empty keys are ignored."""
    out = F.lit(False)
    for k in keys:
        if k.strip():
            out = out | F.contains(F.lower("tag"), F.lit(k.strip().lower()))
    return stats.where(out)


def edit_tags(tags: Column, add: list[str], remove: list[str]) -> Column:
    """Remove, then add what isn't there yet; case doesn't count, order stays."""
    gone = [x for t in remove if (x := t.strip().lower())]
    out = F.filter(tags, lambda t: ~F.lower(strip(t)).isin(gone)) if gone else tags
    for t in add:
        if t.strip():
            new = F.lit(t.strip())
            out = F.when(F.exists(out, lambda x: fold_ascii(strip(x)) == fold_ascii(new)), out).otherwise(F.concat(out, F.array(new)))
    return out


def edit_tag_arrays(tags: Column, add: Column, remove: Column) -> Column:
    """As ``edit_tags``, with what to add and remove in columns; null changes nothing."""
    none = F.array().cast("array<string>")
    gone = F.transform(F.filter(F.coalesce(remove, none), lambda r: strip(r) != ""), lambda r: F.lower(strip(r)))
    left = F.filter(F.coalesce(tags, none), lambda t: ~F.array_contains(gone, F.lower(strip(t))))

    def put(have: Column, t: Column) -> Column:
        there = F.exists(have, lambda x: fold_ascii(strip(x)) == fold_ascii(strip(t)))
        return F.when((strip(t) == "") | there, have).otherwise(F.concat(have, F.array(strip(t))))

    return F.aggregate(F.coalesce(add, none), left, put)


def token_windows(docs: DataFrame, size: int, overlap: int, text: str = "text") -> DataFrame:
    """Fixed windows of words, ``(doc_id, chunk_index, chunk_text, n_tokens)``.

    The overlap is at most a word less than the window; the last window ends
    with the text. Texts without words have none.
    """
    size = max(size, 1)
    step = size - min(max(overlap, 0), size - 1)
    words = docs.select("doc_id", split_words(text).alias("words"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size("words") - size) / F.lit(float(step))).cast("int")))
    return words.where(F.size("words") > 0).select("doc_id", "words", F.explode(starts.cast("array<bigint>")).alias("chunk_index")).select(
        "doc_id", "chunk_index",
        F.array_join(F.slice("words", (F.col("chunk_index") * step + 1).cast("int"), F.lit(size)), " ").alias("chunk_text"),
        F.least(F.lit(size), F.size("words") - F.col("chunk_index") * step).cast("bigint").alias("n_tokens"),
    )


def running_progress(chunks: DataFrame) -> DataFrame:
    """Characters done after each chunk, no more than the document has."""
    w = Window.partitionBy("doc_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy("doc_id")
    n = F.length("chunk_text").cast("bigint")
    return chunks.withColumn("done", F.least(F.sum(n).over(w), F.max("total_chars").over(total)))


def list_docs(docs: DataFrame, query: str = "", newest: str = "uploaded_at", key: str = "id", name: str = "name") -> DataFrame:
    """Newest first; with a query, those that have it in their name."""
    found = docs.where(F.contains(F.lower(name), F.lit(query.strip().lower()))) if query.strip() else docs
    return found.orderBy(F.desc(newest), key)


#: Bytes that an upload may have.
MAX_UPLOAD = 64 << 20


def too_large(text: Column, most: int = MAX_UPLOAD) -> Column:
    """Whether a text has more bytes than an upload may have."""
    return F.octet_length(text) > most


def type_labels(docs: DataFrame, catalog: DataFrame, name: str = "name") -> DataFrame:
    """``label`` of the file type by extension, '' if unknown; the catalog is (ext, label), fixed and small."""
    return docs.withColumn("ext", doc_extension(name)).join(F.broadcast(catalog), "ext", "left").withColumn("label", F.coalesce("label", F.lit("")))


def label_of_type(kinds: DataFrame, catalog: DataFrame, kind: str = "kind") -> DataFrame:
    """``label`` of a bare type such as ``md`` or ``.md``; null if unknown."""
    return kinds.withColumn("ext", F.concat(F.lit("."), bare_extension(kind))).join(F.broadcast(catalog), "ext", "left")


def zero_chunk_counts(docs: DataFrame) -> DataFrame:
    """After the vectors' length changed, nothing is indexed."""
    return docs.withColumn("chunk_count", F.lit(0))
