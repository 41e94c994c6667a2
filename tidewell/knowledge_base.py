"""A knowledge base on Parquet tables: create, update, delete, tag, get and search documents.

``docs``, ``chunks``, ``tag_stats`` and ``results``, what the last change reports, are
tables of one folder that switch together (``tidewell.tables``): a reader sees
all of a change or nothing of it. Tag statistics are stored and kept by what each change
adds and takes. A change rewrites the tables it concerns, so changes are
best made for many documents at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.text import clean_tags, extract_title, sanitize_file_name, with_extension
from tidewell.operators import documents, search
from tidewell.operators.documents import CHUNK
from tidewell.operators.embedding import Embedder, HashingEmbedder, embed_query, index_documents, index_results
from tidewell.plans import mutations
from tidewell.sources.files import type_catalog
from tidewell.tables import Snapshot, Tables

DOC = T.StructType([
    T.StructField("doc_id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("title", T.StringType()), T.StructField("content", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("size", T.LongType()), T.StructField("version", T.IntegerType()),
    T.StructField("file_type", T.StringType()), T.StructField("uploaded_at", T.TimestampType()), T.StructField("chunk_count", T.LongType()),
])

TAGS = T.StructType([T.StructField("tag", T.StringType()), T.StructField("file_count", T.LongType())])


def document_id(name: str) -> str:
    """The id that a document of this name gets; the same on every run."""
    return hashlib.sha256(name.encode()).hexdigest()[:32]


class KnowledgeBase:
    def __init__(
        self, spark: SparkSession, path: str, settings: search.Settings = search.Settings(), make: Callable[[], Embedder] = HashingEmbedder,
        chunk_size: int = 512, chunk_overlap: int = 100, prefixes: tuple[str, str] = ("", ""),
    ):
        self.spark, self.path, self.settings, self.make = spark, path, settings, make
        self.size, self.overlap, (self.doc_prefix, self.query_prefix) = chunk_size, chunk_overlap, prefixes

        self.tables = Tables(spark, path)

    # -- tables --

    def docs(self) -> DataFrame:
        return self.tables.read("docs", DOC)

    def chunks(self) -> DataFrame:
        return self.tables.read("chunks", CHUNK)

    def _held(self, rows: DataFrame) -> DataFrame:
        """The rows, written once; no table names them, so ``vacuum`` removes them later."""
        return self.tables.staged(self.tables.part(rows))

    def _index(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        return index_documents(docs.withColumnRenamed("content", "text"), self.size, self.overlap, self.make, self.doc_prefix, hold=self._held)

    def _labelled(self, docs: DataFrame) -> DataFrame:
        """With the label of the type that the name's extension says."""
        return documents.type_labels(docs.drop("file_type"), type_catalog(self.spark)).withColumnRenamed("label", "file_type").drop("ext")

    def _counted(self, docs: DataFrame, chunks: DataFrame) -> DataFrame:
        n = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
        return docs.drop("chunk_count").join(n, "doc_id", "left").withColumn("chunk_count", F.coalesce("n", F.lit(0).cast("long"))).select(*DOC.names)

    def _change(self, make: Callable[[Snapshot], tuple[DataFrame, DataFrame, DataFrame, DataFrame]]) -> DataFrame:
        """Commit a change and return what it reports.

        ``make`` gives, of the tables as they are, all documents and all chunks after the change, ``(doc_id)``
        of the documents that it concerns, and its report.
        """
        said = []

        def parts(now: Snapshot) -> dict[str, DataFrame | list[dict]]:
            docs, chunks, concerned, report = make(now)
            new_chunks = self.tables.part(chunks)
            new_docs = self.tables.part(self._counted(docs, self.tables.staged(new_chunks)))
            before, after = (d.join(concerned, "doc_id", "left_semi") for d in (now.read("docs", DOC), self.tables.staged(new_docs)))
            stats = documents.add_tag_deltas(now.read("tag_stats", TAGS), documents.tag_deltas(before, after))
            said[:] = [self.tables.part(report)]
            return {"docs": [new_docs], "chunks": [new_chunks], "tag_stats": stats, "results": said}

        self.tables.change(parts)
        return self.tables.staged(said[0])

    # -- changes --

    def create(self, new: DataFrame) -> DataFrame:
        """Add ``(name, kind, content, tags)``; a document of the same file name is replaced.

        Returns ``(doc_id, chunk_count, error)``, the error null where all went well.
        """
        name = with_extension(sanitize_file_name("name"), "kind")
        rows = new.where(sanitize_file_name("name") != "").select(
            F.substring(F.sha2(name, 256), 1, 32).alias("doc_id"), name.alias("name"), extract_title("content", name).alias("title"), "content",
            clean_tags(F.coalesce("tags", F.array().cast("array<string>"))).alias("tags"), F.octet_length("content").cast("long").alias("size"), F.lit(1).alias("version"), F.current_timestamp().alias("uploaded_at"),
        )
        large = rows.where(documents.too_large(F.col("content")))
        one = self._held(self._labelled(mutations.last_write(rows.where(~documents.too_large(F.coalesce("content", F.lit("")))), ["doc_id"], ["content"])))
        table, failed = self._index(one)  # its chunks are held; vectors are made where the change writes them
        report = index_results(one, table, failed).unionByName(large.select("doc_id", F.lit(0).cast("long").alias("chunk_count"), F.lit("too large").alias("error")))

        def make(now: Snapshot):
            gone = now.read("docs", DOC).join(one.select("name"), "name", "left_semi").select("doc_id")
            ids = one.select("doc_id").unionByName(gone).distinct()
            docs = mutations.create_document(now.read("docs", DOC), one.withColumn("chunk_count", F.lit(0).cast("long")).select(*DOC.names))
            return docs, mutations.delete_matching(now.read("chunks", CHUNK), ids, ["doc_id"]).unionByName(table), ids, report

        return self._change(make)

    def update(self, changes: DataFrame, append_text: bool = False) -> DataFrame:
        """Name, content and tags of ``doc_id`` as far as given; changed content is indexed anew.

        ``tags`` replaces, ``add_tags`` and ``remove_tags`` change; an empty name
        after cleaning changes nothing. The version stays. Returns ``(doc_id,
        error)`` of the changes that were not made: unknown documents, and texts
        that would be too large. It is a written table, whatever its length.
        """
        changes = mutations.one_each(changes, ["doc_id"])

        def make(now: Snapshot):
            old = now.read("docs", DOC)
            asked = changes.join(old.select("doc_id", "tags", "content").withColumnsRenamed({"tags": "_tags", "content": "_old"}), "doc_id")
            refused = changes.join(old, "doc_id", "left_anti").select("doc_id", F.lit("not found").alias("error"))
            if "content" in changes.columns:
                whole = F.concat_ws("\n", "_old", "content") if append_text else F.coalesce("content", "_old")
                asked = asked.withColumn("_large", documents.too_large(F.coalesce(whole, F.lit(""))))
            if "name" in changes.columns:
                asked = asked.withColumn("name", F.nullif(sanitize_file_name("name"), F.lit("")))
            if {"add_tags", "remove_tags"} & set(changes.columns):
                given = F.coalesce("tags", "_tags") if "tags" in changes.columns else F.col("_tags")
                none = F.lit(None).cast("array<string>")
                parts = (F.col(c) if c in changes.columns else none for c in ("add_tags", "remove_tags"))
                asked = asked.withColumn("tags", documents.edit_tag_arrays(given, *parts))
            # Held, as many plans below use it and each would move all old texts again.
            asked = self._held(asked.drop("_tags", "_old"))
            if "content" in changes.columns:
                refused = refused.unionByName(asked.where("_large").select("doc_id", F.lit("too large").alias("error")))
                asked = asked.where("not _large").drop("_large")
            docs = mutations.update_document(old, asked, append_text).withColumn("size", F.octet_length("content").cast("long"))
            if "name" in changes.columns:
                docs = self._labelled(docs).select(*DOC.names)
            changed = docs.join(asked.select("doc_id"), "doc_id", "left_semi")
            if "content" in changes.columns:
                chunks = mutations.delete_matching(now.read("chunks", CHUNK), asked, ["doc_id"]).unionByName(self._index(changed)[0])
            else:
                chunks = mutations.retag(now.read("chunks", CHUNK), changed.select("doc_id", "tags"))
            return docs, chunks, asked.select("doc_id"), refused

        return self._change(make)

    def update_files(self, files: DataFrame) -> DataFrame:
        """New files ``(doc_id, name, content)`` for known documents: the version counts up, id and tags stay.

        Returns ``(doc_id, error)`` of those that are too large.
        """
        large = documents.too_large(F.coalesce("content", F.lit("")))
        new = mutations.one_each(files.where(~large).select("doc_id", F.col("name").alias("_name"), F.col("content").alias("_content")), ["doc_id"])

        def make(now: Snapshot):
            docs = now.read("docs", DOC).join(new.withColumn("_new", F.lit(True)), "doc_id", "left")
            is_new = F.coalesce("_new", F.lit(False))
            docs = docs.withColumns({
                "name": F.when(is_new, F.coalesce("_name", "name")).otherwise(F.col("name")), "content": F.when(is_new, F.col("_content")).otherwise(F.col("content")),
                "version": F.col("version") + is_new.cast("int"), "uploaded_at": F.when(is_new, F.current_timestamp()).otherwise(F.col("uploaded_at")),
            })
            docs = docs.withColumns({"title": F.when(is_new, extract_title("content", F.col("name"))).otherwise(F.col("title")), "size": F.octet_length("content").cast("long")})
            changed = docs.where(is_new)
            chunks = mutations.delete_matching(now.read("chunks", CHUNK), new, ["doc_id"]).unionByName(self._index(changed.select(*DOC.names))[0])
            return self._labelled(docs).select(*DOC.names), chunks, new.select("doc_id"), files.where(large).select("doc_id", F.lit("too large").alias("error"))

        return self._change(make)

    def set_tags(self, tags: DataFrame) -> None:
        """Replace the tags of ``(doc_id, tags)``; vectors and ids of chunks stay."""
        cleaned = tags.select("doc_id", clean_tags("tags").alias("tags"))
        self._change(lambda now: (mutations.retag(now.read("docs", DOC), cleaned), mutations.retag(now.read("chunks", CHUNK), cleaned), cleaned.select("doc_id"), cleaned.select("doc_id").limit(0)))

    def delete(self, ids: DataFrame) -> None:
        self._change(lambda now: (*mutations.delete_documents(now.read("docs", DOC), now.read("chunks", CHUNK), ids), ids.select("doc_id"), ids.select("doc_id").limit(0)))

    def reindex(self) -> DataFrame:
        """Index all documents anew; returns those that failed, which keep no chunks."""

        def make(now: Snapshot):
            docs = now.read("docs", DOC)
            table, failed = self._index(docs)
            return docs, table, docs.select("doc_id").limit(0), failed

        return self._change(make)

    def compact(self) -> None:
        """Rewrite small files, then remove what no current table needs and no one can be writing."""
        for name in ("docs", "chunks", "tag_stats"):
            self.tables.compact(name)
        self.tables.vacuum()

    # -- reading --

    def listed(self, query: str = "") -> DataFrame:
        """Documents, newest first."""
        return documents.list_docs(self.docs(), query, key="doc_id")

    def get(self, doc_id: str) -> DataFrame:
        return self.docs().where(F.col("doc_id") == doc_id)

    def chunks_of(self, doc_id: str) -> DataFrame:
        return self.chunks().where(F.col("doc_id") == doc_id).orderBy("chunk_index")

    def tag_stats(self) -> DataFrame:
        """``(tag, file_count)`` as stored."""
        return self.tables.read("tag_stats", TAGS)

    def rebuild_tag_stats(self) -> None:
        """Count all tags anew and store that, as for tables that others have written."""
        self.tables.change(lambda now: {"tag_stats": documents.tag_stats(now.read("docs", DOC))})

    def tag_search(self, keys: list[str]) -> DataFrame:
        return documents.search_tags(self.tag_stats(), keys)

    def search(self, query: str, tags: list[str] | None = None) -> DataFrame:
        """Hits by falling score, with the documents' titles; chunks and titles are of one version."""
        vector, now = embed_query(query, self.make, self.query_prefix), self.tables.snapshot()
        return search.hybrid_search(now.read("chunks", CHUNK), query, vector, self.settings, tags, now.read("docs", DOC))
