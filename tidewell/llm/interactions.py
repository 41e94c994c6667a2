"""Which filter removes what, for every order in which filters may be applied.

The text of every document is read once and gives a mask: a bit for each filter
that it fails. Documents of a part with one mask are a cell, and all orders can
be told from the cells: at most ``2 ** k`` of them a part, whatever the number
of documents. A walk in Gray-code order then visits every set of switched-on
filters, toggling one at a time. Each cell keeps how many of its failing filters
are on; only a cell whose counter leaves or reaches zero changes the survivors.
The survivors of the ``2 ** k`` states are stored, and every step of every order
is the difference of two of them.

Texts are compared by SHA-256. Rows are only exchanged with digest and mask, after
equal ones were counted together, so a group of copies of any size is spread by
its ids; no group is gathered.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import materialize

#: What a walk keeps of a cell: documents, good ones and toxic ones.
WEIGHTS = ("n", "good", "toxic")
#: More filters than these would give more than 7! * 7 rows a part.
MOST = 7


def default_filters() -> dict[str, Column]:
    """Failure conditions on the column ``text`` (not null), by filter name."""
    text = F.col("text")
    words = F.col("words")
    upper = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 200,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        "C": upper * 100 > F.length(text) * 3,
        "D": text.rlike(r"[#$%&*|]"),
    }


def failure_rows(docs: DataFrame, filters: dict[str, Column], part: str = "lang") -> DataFrame:
    """``(doc_id, digest, part, mask, m)``: how many rows have this id, text, part and failures of the given filters.

    A null text is empty, a null part the empty string. Columns besides are not looked at.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    mask = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(filters.values())), F.lit(0))
    return rows.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), "part", mask.alias("mask")).groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("m"))


def cells(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], part: str = "lang") -> DataFrame:
    """``(part, mask, n, good, toxic)``; the bit after those of ``filters`` is that of the copies of a smaller id's text."""
    copy = 1 << len(filters)
    rows = materialize(failure_rows(docs, filters, part), "interaction-rows")
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("long"), F.lit(0).cast("long"))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("long"), F.lit(0).cast("long"))).alias("toxic")
    )
    none = F.lit(0).cast("long")
    # Rows without an id match no label; they stay out of the join, where they would meet in one task.
    labelled = rows.where("doc_id is not null").join(known, "doc_id", "left").select(*rows.columns, F.coalesce("good", none).alias("good"), F.coalesce("toxic", none).alias("toxic"))
    labelled = labelled.unionByName(rows.where("doc_id is null").withColumns({"good": none, "toxic": none}))
    lows = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    # The key of the join has the id, so copies of one text are spread.
    told = labelled.join(lows, ["digest", "doc_id"], "left")
    whole = F.col("mask") + F.when(F.col("first").isNotNull() | F.col("doc_id").isNull(), 0).otherwise(copy)
    return told.groupBy("part", whole.alias("mask")).agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("good")).alias("good"), F.sum(F.col("m") * F.col("toxic")).alias("toxic"))


def walk(masks: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Survivors of each set of ``k`` filters: a row for each set, the columns of ``weights``.

    ``masks`` are the cells' failing filters. State ``s`` has the filters of its bits on.
    """
    states = np.zeros((1 << k, weights.shape[1]), dtype=np.int64)
    failing = np.zeros(len(masks), dtype=np.int64)
    alive = weights.sum(axis=0)
    states[0] = alive
    on = 0
    for i in range(1, 1 << k):
        bit = (i & -i).bit_length() - 1  # the one that the Gray code toggles
        on ^= 1 << bit
        held = (masks >> bit) & 1 == 1
        if on >> bit & 1:
            alive = alive - weights[held & (failing == 0)].sum(axis=0)
            failing[held] += 1
        else:
            failing[held] -= 1
            alive = alive + weights[held & (failing == 0)].sum(axis=0)
        states[on] = alive
    return states


def steps(names: str, masks: np.ndarray, weights: np.ndarray) -> pd.DataFrame:
    """The steps of all orders of the filters ``names`` (a letter each), from one part's cells."""
    k = len(names)
    states = walk(masks, weights, k)
    fails = [int(weights[(masks >> f) & 1 == 1, 0].sum()) for f in range(k)]
    unique = [int(weights[masks == 1 << f, 0].sum()) for f in range(k)]
    # A set of s other filters stands before f in s! * (k - 1 - s)! of the orders.
    orders = [factorial(s) * factorial(k - 1 - s) for s in range(k)]
    shapley = [sum(orders[s.bit_count()] * int(states[s, 0] - states[s | 1 << f, 0]) for s in range(1 << k) if not s >> f & 1) for f in range(k)]
    out = []
    for order in permutations(sorted(range(k), key=names.__getitem__)):
        on, name = 0, "".join(names[f] for f in order)
        for step, f in enumerate(order, 1):
            now = on | 1 << f
            gone = states[on] - states[now]
            out.append((name, step, int(states[now, 0]), int(gone[0]), fails[f] - int(gone[0]), unique[f], int(gone[1]), int(gone[2]), shapley[f]))
            on = now
    return pd.DataFrame(out, columns=["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, copies: str = "E", part: str = "lang") -> DataFrame:
    """A row for each part, order of all filters and step: what the step's filter keeps and removes there.

    ``filters`` are failure conditions by a letter, on ``text`` and its ``words``; ``copies`` names
    the one of texts that a smaller doc_id also has. Columns: ``part, filter_order, step, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley``.

    A null text is empty and a copy of any other such; very long texts are whole. Rows are
    counted one by one, repeated ones too; rows that share the smallest doc_id of a text are
    none of its copies, nor is a row without an id, and no label belongs to it. Several labels
    of a doc_id count as one: good if any has ``quality`` 1, toxic if any has ``toxic`` 1. A
    null part is the empty string. Other columns play no part. No documents give no rows.
    """
    chosen = default_filters() if filters is None else filters
    names = "".join(chosen) + copies
    if len(names) > MOST or len(set(names)) < len(names) or any(len(x) != 1 for x in (*chosen, copies)):
        raise ValueError(f"filters need different names of one letter, at most {MOST}")

    def of_part(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        out = steps(names, pdf["mask"].to_numpy(), pdf[list(WEIGHTS)].to_numpy(dtype=np.int64))
        out.insert(0, "part", key[0])
        return out

    kinds = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return cells(docs, labels, chosen, part).groupBy("part").applyInPandas(of_part, kinds)
