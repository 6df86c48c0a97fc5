"""Session helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..scratch import is_small, materialise, maybe_broadcast, numbered, release, scratch_dir

__all__ = ["added_names", "fresh", "is_small", "materialise", "maybe_broadcast", "numbered", "release", "scratch_dir", "table"]


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def added_names(df: DataFrame, *names: str) -> list[str]:
    """The names of columns to add, each with underscores appended while df has such a column."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
