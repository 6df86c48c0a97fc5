"""Exact deduplication with a heavy-hitter split.

Texts are equal when identical after dropping every character of
``[\\x20\\x09-\\x0D]``. One pass sums Misra-Gries counters of the digests; every
digest with more than 2/(k+1) of all rows is among at most k survivors. Their
winners are aggregated exactly (map-side combine) and broadcast, so their rows
never move; only the other digests, none of which is frequent, are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Misra-Gries counters; also the bound on the broadcast winners.
COUNTERS = 1024
WHITE = " \t\n\x0b\x0c\r"


def digest(text: Column) -> Column:
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), WHITE, ""), 256)


class MisraGries:
    """Counters that underestimate each value's count by at most n / (size + 1)."""

    def __init__(self, size: int):
        self.size, self.counts = size, {}

    def add(self, values: np.ndarray, times: np.ndarray) -> None:
        counts = self.counts
        for v, n in zip(values.tolist(), times.tolist(), strict=True):
            counts[v] = counts.get(v, 0) + n
        if len(counts) > self.size:
            cut = np.partition(np.fromiter(counts.values(), np.int64), len(counts) - self.size - 1)[len(counts) - self.size - 1]
            self.counts = {v: n - int(cut) for v, n in counts.items() if n > cut}


def heavy_hitters(df: DataFrame, col: str, counters: int = COUNTERS) -> DataFrame:
    """Values of col that may have over 2 / (counters + 1) of all rows: all such, at most `counters` of them.

    Each task's summary has at most `counters` rows; summaries add up to counts
    that are short by n / (counters + 1) at most.
    """
    kind = df.schema[col].dataType

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mg, n = MisraGries(counters), 0
        for b in batches:
            found = b.column(0).value_counts()
            mg.add(np.array(found.field(0).to_pylist(), object), found.field(1).to_numpy(zero_copy_only=False))
            n += b.num_rows
        rows = [(None, n, True), *((v, c, False) for v, c in mg.counts.items())] if n else []
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.bool_())],
            names=["value", "n", "total"],
        )

    summed = (
        df.select(F.col(col).cast("string").alias("value"))
        .mapInArrow(summary, "value string, n long, total boolean")
        .groupBy("value", "total")
        .agg(F.sum("n").alias("n"))
    )
    summed = materialise(summed, "heavy")
    n = summed.filter("total").agg(F.sum("n")).first()[0] or 0
    return summed.filter(~F.col("total") & F.col("value").isNotNull() & (F.col("n") * (counters + 1) > n)).select(F.col("value").cast(kind).alias(col))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the one with the most code points in the original text, then
    the smallest id stays. Null text counts as empty; empty and white texts are
    one group. A null id loses to every other id. Rows that repeat one id and
    text are one document: they share its fate, and each counts in group_size.
    Other columns are ignored. An empty table gives an empty result. A very long
    text is digested whole, in one pass.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("len"), digest(F.col(text_col)).alias("text_sha256")
    )
    rows = materialise(rows, "digests")
    hot = F.broadcast(heavy_hitters(rows, "text_sha256", counters))
    best = F.min(F.struct((-F.col("len")).alias("neg"), F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id")))
    winners = rows.join(hot, "text_sha256", "left_semi").groupBy("text_sha256").agg(best.alias("best"), F.count("*").alias("group_size"))
    winners = materialise(winners, "winners")
    frequent = rows.join(F.broadcast(winners), "text_sha256")
    group = Window.partitionBy("text_sha256")
    rest = (
        rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
        .withColumns({"best": best.over(group), "group_size": F.count("*").over(group)})
        .select(*frequent.columns)
    )
    return frequent.unionByName(rest).select(
        "doc_id",
        F.col("best.id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col("len") == -F.col("best.neg"))).alias("kept"),
        "text_sha256",
    )
