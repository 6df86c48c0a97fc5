"""Reads as a stream: windowed counts and a running consensus per barcode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def barcode_counts(reads: DataFrame, width: int, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """reads (ts, seq) -> window, barcode, n. Reads later than `late` are dropped, state of older windows goes."""
    counted = reads.withWatermark("ts", late).groupBy(F.window("ts", window), F.left(F.col("seq"), F.lit(width)).alias("barcode")).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "barcode", "n")


def base_votes(reads: DataFrame, width: int, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Votes per window, barcode, position and base: what a consensus needs, as one streaming aggregate."""
    at = reads.withWatermark("ts", late).select("ts", F.left(F.col("seq"), F.lit(width)).alias("barcode"), F.posexplode(F.split("seq", "")).alias("pos", "base")).filter("base <> ''")
    return at.groupBy(F.window("ts", window), "barcode", "pos", "base").agg(F.count("*").alias("n"))


def consensus_of(votes: DataFrame) -> DataFrame:
    """A batch of votes (in foreachBatch, or read back) as start, barcode, seq; ties go to the lesser base."""
    best = votes.groupBy("window", "barcode", "pos").agg(F.min(F.struct((-F.col("n")).alias("n"), "base"))["base"].alias("base"))
    parts = F.array_sort(F.collect_list(F.struct("pos", "base")))
    return best.groupBy("window", "barcode").agg(F.array_join(F.transform(parts, lambda x: x["base"]), "").alias("seq")).select(F.col("window.start").alias("start"), "barcode", "seq")
