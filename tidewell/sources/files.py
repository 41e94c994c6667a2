"""File sources: uploads, document metadata, skills, logs, event streams.

Listings and contents come from Spark's own readers, so any store that Spark
reads will do; per file there is at most a small Arrow function.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.text import extract_title, parse_json_or_null
from tidewell.sources.file_types import TYPE_LABELS

#: Largest upload in bytes, and how much of one the sniffer looks at.
MAX_BYTES, SNIFFED = 64 << 20, 8192

DOC_META = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("title", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("size", T.LongType()), T.StructField("uploaded_at", T.TimestampNTZType()), T.StructField("chunk_count", T.IntegerType()), T.StructField("version", T.IntegerType()),
    T.StructField("file_type", T.StringType()),
])


def type_catalog(spark: SparkSession) -> DataFrame:
    """``(ext, label)`` of the known file types, a fixed, small table."""
    return spark.createDataFrame(sorted(TYPE_LABELS.items()), "ext string, label string")


def likely_text(sample: bytes) -> bool:
    """No NUL and less than three tenths of control bytes in the first 8192; empty is text."""
    part = sample[:SNIFFED]
    if not part:
        return True
    if 0 in part:
        return False
    odd = sum(1 for b in part if not (b in (9, 10, 13) or 32 <= b <= 126 or b >= 128))
    return odd / len(part) < 0.30


def decode_bytes(raw: bytes) -> tuple[str, str]:
    """Text and encoding: UTF-8, UTF-16 with a mark, then GB18030, then Windows-1252."""
    for name in ("utf-8-sig", "utf-16" if raw[:2] in (b"\xff\xfe", b"\xfe\xff") else "gb18030"):
        try:
            return raw.decode(name), name
        except UnicodeDecodeError:
            continue
    return raw.decode("cp1252", errors="replace"), "cp1252"


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("encoding", T.StringType()), T.StructField("error", T.StringType())]))
def judge_content(content: pd.Series) -> pd.DataFrame:
    """Text and encoding of what is text, an error for what isn't."""
    rows = [(*decode_bytes(raw), None) if likely_text(raw) else (None, None, "not text") for raw in (bytes(b or b"") for b in content)]
    return pd.DataFrame(rows, columns=["text", "encoding", "error"])


def list_files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """``(path, name, size)`` of all files, empty ones too; no content is read.

    Spark's scan passes by files of no bytes; the paths of its own listing tell which these are.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(path)
    scanned = raw.select("path", F.col("length").alias("size"))
    every = spark.createDataFrame([(unquote(p),) for p in raw.inputFiles()], "listed string")
    plain = lambda c: F.regexp_replace(c, r"^file:/+", "/")  # noqa: E731  the two listings write the root of local paths differently
    empty = every.join(scanned.select(plain("path").alias("seen")), plain("listed") == F.col("seen"), "left_anti").select(F.regexp_replace("listed", r"^file:/+", "file:/").alias("path"), F.lit(0).cast("long").alias("size"))
    return scanned.unionByName(empty).select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "size")


def read_uploads(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True, most: int = MAX_BYTES) -> DataFrame:
    """``(path, name, size, text, encoding, title, error)`` of all files.

    A file that is too large or not text has an error instead of text. The listing comes first:
    sizes are judged on it, and only contents of at most ``most`` bytes are read, once for both
    outcomes. An empty file is an empty text.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(path)
    # The reader takes the filter on the length before it opens a file.
    small = raw.where(F.col("length") <= most).select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("size"), judge_content("content").alias("d"))
    title = lambda text: F.when(text.isNotNull(), extract_title(text, "name"))
    judged = small.select("path", "name", "size", "d.text", "d.encoding", title(F.col("d.text")).alias("title"), "d.error")
    none, listed = F.lit(None).cast("string"), list_files(spark, path, glob, recursive)
    large = listed.where(F.col("size") > most).select("path", "name", "size", none.alias("text"), none.alias("encoding"), none.alias("title"), F.lit("too large").alias("error"))
    nothing = F.lit("")
    empty = listed.where("size = 0").select("path", "name", "size", nothing.alias("text"), F.lit("utf-8-sig").alias("encoding"), extract_title(nothing, "name").alias("title"), none.alias("error"))
    return judged.unionByName(large).unionByName(empty)


def read_metadata(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Metadata documents, one JSON file each, newest first; a broken one fails
    the listing, or is left out when not ``strict``."""
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    return spark.read.schema(DOC_META).option("multiLine", True).option("mode", mode).json(path).orderBy(F.desc("uploaded_at"), "id")


# ---- skills ------------------------------------------------------------------

BLOCK = re.compile(r"[>|][0-9+-]*$")


def front_matter(text: str, fallback: str) -> tuple[str, str]:
    """Name and description between the leading ``---`` lines; folded and literal blocks are joined."""
    lines = text.splitlines()
    if not lines or lines[0].strip() != "---":
        return fallback, ""
    found: dict[str, str] = {}
    at = 1
    while at < len(lines) and lines[at].strip() != "---":
        key, colon, value = lines[at].strip().partition(":")
        value, at = value.strip(), at + 1
        if not colon:
            continue
        if BLOCK.match(value):
            part = []
            while at < len(lines) and lines[at].strip() != "---" and (not lines[at].strip() or lines[at][0].isspace()):
                part.append(lines[at].strip())
                at += 1
            value = " ".join(x for x in part if x) if value[0] == ">" else "\n".join(part)
        else:
            value = value.strip("\"'")
        found[key.strip()] = value
    return found.get("name", fallback), found.get("description", "").strip()


def read_skills(spark: SparkSession, path: str) -> DataFrame:
    """``(dir_name, path, name, description)`` of the folder itself if it has a
    skill file, else of its direct children that have one."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{SKILL,skill}.md").load(path)
    placed = raw.select("path", "content", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("dir_name"), F.size(F.split("path", "/")).alias("depth"))
    root = len(str(path).rstrip("/").removeprefix("file:").lstrip("/").split("/"))
    rest = F.size(F.split(F.regexp_replace("path", r"^[a-z0-9]+:/*", ""), "/")) - root
    inside = placed.withColumn("level", rest).where(F.col("level").isin(1, 2))
    top = inside.agg(F.min("level").alias("top"))
    chosen = inside.join(F.broadcast(top), F.col("level") == F.col("top"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            both = [front_matter(decode_bytes(bytes(c))[0], d) for c, d in zip(b["content"], b["dir_name"], strict=True)]
            yield pd.DataFrame({"dir_name": b["dir_name"], "path": b["path"], "name": [x[0] for x in both], "description": [x[1] for x in both]})

    return chosen.select("path", "content", "dir_name").mapInPandas(parse, "dir_name string, path string, name string, description string")


def list_directories(spark: SparkSession, path: str) -> DataFrame:
    """``(dir_name)`` of the direct children of a folder that hold files."""
    root = len(str(path).rstrip("/").removeprefix("file:").lstrip("/").split("/"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    parts = F.split(F.regexp_replace("path", r"^[a-z0-9]+:/*", ""), "/")
    return files.where(F.size(parts) - root >= 2).select(F.get(parts, F.lit(root)).alias("dir_name")).distinct()


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """``(family, size, status, label)`` of model folders ``family/size/``: ready with
    weights, downloadable with a description only; sorted ready first, then by label."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    m = lambda i: F.regexp_extract("path", r"([^/]+)/([^/]+)/([^/]+)$", i)
    each = files.select(m(1).alias("family"), m(2).alias("size"), m(3).alias("file"))
    state = each.groupBy("family", "size").agg(F.max(F.col("file").rlike(r"\.(gguf|safetensors|onnx)$")).alias("ready"), F.max(F.col("file") == "deploy.json").alias("known"))
    order = F.when(F.col("ready"), 0).when(F.col("known"), 1).otherwise(2)
    return state.select("family", "size", F.when(F.col("ready"), "ready").when(F.col("known"), "downloadable").otherwise("unavailable").alias("status"), F.concat_ws(" ", "family", "size").alias("label"), order.alias("sort")).orderBy("sort", "label").drop("sort")


# ---- logs and streams --------------------------------------------------------


def sse_messages(lines: DataFrame, wanted: str | None = None) -> DataFrame:
    """``(id, payload)`` of the ``data:`` lines of an event stream, JSON only; batch or streaming."""
    data = lines.where(F.startswith("value", F.lit("data:"))).select(F.trim(F.substring("value", 6, 1 << 30)).alias("payload"))
    out = data.where(parse_json_or_null("payload").isNotNull()).select(F.get_json_object("payload", "$.id").alias("id"), "payload")
    return out if wanted is None else out.where(F.col("id") == wanted)


def write_log_files(lines: DataFrame, path: str) -> None:
    """One folder a day of plain text lines."""
    lines.write.partitionBy("day").mode("append").text(path)


def day_log_files(spark: SparkSession, path: str) -> DataFrame:
    """``(day, line)`` of written logs; a filter on the day reads no other folder."""
    return spark.read.text(path).select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("value").alias("line"))
