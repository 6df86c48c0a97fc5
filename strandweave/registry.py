"""Named methods per stage, with defaults and checks. A user's method is a function of DataFrames, or of Arrow strings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import channels, mesa

STAGES = ("binarize", "encode", "decode", "synthesis", "storage", "errors", "sequencing")


@dataclass(frozen=True)
class Method:
    """transform(df, **params); limits: name -> (least, most)."""

    transform: Callable[..., DataFrame]
    defaults: dict = field(default_factory=dict)
    limits: dict = field(default_factory=dict)

    def __call__(self, df: DataFrame, **params) -> DataFrame:
        unknown = set(params) - set(self.defaults) - {"seed"}
        if unknown:
            raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
        merged = {**self.defaults, **params}
        for name, (low, high) in self.limits.items():
            if not low <= merged[name] <= high:
                raise ValueError(f"{name} must be from {low} to {high}")
        return self.transform(df, **merged)


_methods: dict[tuple[str, str], Method] = {}


def register(stage: str, name: str, method: Method) -> None:
    if stage not in STAGES:
        raise ValueError(f"no stage {stage}")
    _methods[stage, name] = method


def register_strands(stage: str, name: str, fn: Callable[[pa.Array], pa.Array], column: str = "dna") -> None:
    """A function of Arrow string arrays as a method on a strand column."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield fn(b)

    register(stage, name, Method(lambda df, **_: df.withColumn(column, F.arrow_udf(run, "string")(column))))


def method(stage: str, name: str) -> Method:
    if (stage, name) not in _methods:
        raise ValueError(f"no method {name} for {stage}; there are {', '.join(sorted(n for s, n in _methods if s == stage))}")
    return _methods[stage, name]


def names(stage: str) -> list[str]:
    return sorted(n for s, n in _methods if s == stage)


def _as_dna(df: DataFrame) -> DataFrame:
    """What a channel made becomes the strand that the next stage sees."""
    if "mutated" in df.columns:
        return df.withColumn("dna", F.col("mutated.seq")).drop("mutated")
    if "read" in df.columns:
        return df.withColumn("dna", F.col("read")).drop("read", "n_changed")
    return df


def _then(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    return lambda df, **p: _as_dna(fn(df, **p))


def _install() -> None:
    rate = {"rate": (0.0, 1.0)}
    for name in channels.DECAY:
        register("storage", name, Method(lambda df, name=name, **p: channels.store(df, name, **p), {"years": 100.0}, {"years": (0.0, 1e9)}))
    register("storage", "random", Method(channels.random_storage))
    register("synthesis", "none", Method(lambda df, **_: df.withColumn("copy_no", F.lit(0))))
    register("synthesis", "copies", Method(channels.copies, {"mean": 1.0, "std": 0.0}, {"mean": (0.0, 1e6)}))
    register("synthesis", "mesa", Method(_then(mesa.synthesis), {"profile_id": 68, "mean": 10.0, "std": 2.0}))
    register("errors", "iid", Method(_then(lambda df, **p: channels.substitute_iid(df, distinct=True, exact=False, **p)), {"rate": 0.01}, rate))
    register("errors", "homopolymer", Method(_then(channels.homopolymer_slips), {"rate": 0.01}, rate))
    register("sequencing", "none", Method(lambda df, **_: df))
    register("sequencing", "iid", Method(_then(lambda df, **p: channels.substitute_iid(df, exact=False, **p)), {"rate": 0.01}, rate))
    register("sequencing", "illumina", Method(_then(lambda df, **p: channels.channel_indel(df, 1e-6, 1e-6, 0.01 * (1 - channels.ILLUMINA_STAY), slope=True, **p))))
    register("sequencing", "nanopore", Method(_then(lambda df, **p: channels.channel_indel(df, 0.01, 0.01, 0.01 * (1 - channels.NANOPORE_STAY), slope=True, **p))))
    register("sequencing", "mesa", Method(_then(mesa.sequencing), {"profile_id": 38}))
    register("sequencing", "markov", Method(_then(channels.channel_markov), {"p_ins": 0.01, "p_del": 0.01, "p_sub": 0.01, "k": 3}))


_install()
