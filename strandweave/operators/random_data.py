"""Seeded random strands, bits, codewords and texts: each character is a hash of its row and place."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rng
from ..scratch import maybe_broadcast

LETTERS = string.ascii_letters + string.digits
#: Characters of a text in one row.
PIECE = 4096


def random_string(alphabet: str, length: int | Column, seed: int, *key: Column) -> Column:
    """A string over the alphabet, uniform in every place."""
    n = length if isinstance(length, Column) else F.lit(length)

    def one(i: Column) -> Column:
        return F.substring(F.lit(alphabet), (F.floor(rng.uniform(seed, "char", *key, i) * len(alphabet)) + 1).cast("int"), F.lit(1))

    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), n), one), "")).otherwise("")


def random_string_sql(alphabet: str, length: str, seed: int, *key: str) -> str:
    u = rng.uniform_sql(f"'{seed}'", "'char'", *key, "i")
    return f"array_to_string(list_transform(range(1, {length} + 1), lambda i: substr('{alphabet}', (floor({u} * {len(alphabet)}) + 1)::BIGINT, 1)), '')"


def strands(spark: SparkSession, n: int, length: int, seed: int = 0) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("strand_idx"), random_string("ACGT", length, seed, F.col("id")).alias("dna"))


def bit_strings(spark: SparkSession, n: int, length: int, seed: int = 0) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("payload_id"), random_string("01", length, seed, F.col("id")).alias("bits"))


def codewords(spark: SparkSession, n: int, length: int, library: DataFrame, seed: int = 0) -> DataFrame:
    """codeword_id, oligos: arrays of oligos drawn from a library whose idx runs from 0 without gaps."""
    m = library.count()
    drawn = spark.range(n).select(F.col("id").alias("codeword_id"), F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("pos"))
    drawn = drawn.withColumn("idx", F.floor(rng.uniform(seed, "oligo", F.col("codeword_id"), F.col("pos")) * m))
    found = drawn.join(maybe_broadcast(library.select(F.col("idx").cast("long"), "oligo")), "idx")
    return found.groupBy("codeword_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "oligo"))), lambda x: x["oligo"]).alias("oligos"))


def texts(spark: SparkSession, sizes: list[int], seed: int = 0) -> DataFrame:
    """file_id, n_bytes, piece, text: files of letters and digits in pieces, so that a long one is many rows."""
    files = spark.createDataFrame(list(enumerate(sizes)), "file_id long, n_bytes long")
    cut = files.withColumn("piece", F.explode(F.when(F.col("n_bytes") > 0, F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_bytes") - 1) / PIECE))).otherwise(F.array(F.lit(0).cast("long")))))
    size = F.least(F.lit(PIECE), F.col("n_bytes") - F.col("piece") * PIECE).cast("int")
    return cut.withColumn("text", random_string(LETTERS, size, seed, F.col("file_id"), F.col("piece")))
