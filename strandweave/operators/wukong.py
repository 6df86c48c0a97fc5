"""Paired-segment codec: two segments share a strand through two dinucleotide rules; pairs are chosen for runs and GC."""

from __future__ import annotations

import functools
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bits
from .codecs import repair_segments, segments

PARTNERS, ATTEMPTS = 30, 200
SHUFFLE_SEED = 27
WINDOW, STEP = 150, 140
NUCLEOTIDES = "ACGT"


@functools.cache
def rule(number: int = 1) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Dinucleotides of the four-bit values at even and at odd places: seeded orders of all sixteen."""
    pairs = [a + b for a in NUCLEOTIDES for b in NUCLEOTIDES]
    made = []
    for seed in (1953 + number, 2022 + number):
        order = pairs.copy()
        random.Random(seed).shuffle(order)
        made.append(tuple(order))
    return made[0], made[1]


def combine(a: str, b: str, number: int) -> str:
    """Bits a0 b0 b1 a1 of each two, as dinucleotides by place."""
    even, odd = rule(number)
    out = []
    for k, i in enumerate(range(0, len(a), 2)):
        value = int(a[i] + b[i] + b[i + 1] + a[i + 1], 2)
        out.append((odd if k % 2 else even)[value])
    return "".join(out)


def separate(dna: str, number: int) -> tuple[str, str] | None:
    even, odd = rule(number)
    a, b = [], []
    for k, i in enumerate(range(0, len(dna) - 1, 2)):
        table = odd if k % 2 else even
        pair = dna[i : i + 2]
        if pair not in table:
            return None
        v = f"{table.index(pair):04b}"
        a.append(v[0] + v[3])
        b.append(v[1] + v[2])
    return "".join(a), "".join(b)


def acceptable(dna: str, max_run: int, gc_min: float, gc_max: float) -> bool:
    for i in range(0, len(dna), STEP):
        w = dna[i : i + WINDOW]
        gc = (w.count("G") + w.count("C")) / len(w)
        if not gc_min <= gc <= gc_max or any(b * (max_run + 1) in w for b in NUCLEOTIDES):
            return False
    return True


def _pair_up(segs: list[str], index_bits: int, number: int, max_run: int, gc: tuple[float, float], seed: int) -> list[str]:
    """Strands of all segments. A segment without a partner meets a virtual one, whose index has its top bit set."""
    order = list(range(len(segs)))
    random.Random(SHUFFLE_SEED).shuffle(order)
    g = random.Random(seed)
    out = []
    width = len(segs[0]) if segs else 0

    def virtual() -> str:
        return "1" + "".join(g.choice("01") for _ in range(width - 1))

    while order:
        mine = segs[order.pop()]
        for j in range(len(order) - 1, max(-1, len(order) - 1 - PARTNERS), -1):
            dna = combine(mine, segs[order[j]], number)
            if acceptable(dna, max_run, *gc):
                out.append(dna)
                order.pop(j)
                break
        else:
            best = None
            for _ in range(ATTEMPTS):
                dna = combine(mine, virtual(), number)
                off = abs((dna.count("G") + dna.count("C")) / len(dna) - sum(gc) / 2)
                if acceptable(dna, max_run, *gc):
                    best = (0.0, dna)
                    break
                best = min(best or (9.0, ""), (off, dna))
            out.append(best[1])
    return out


def encode(payload: DataFrame, capacity: int = 200, index_bits: int = 16, number: int = 1, max_run: int = 4, gc: tuple[float, float] = (0.4, 0.6), redundancy: bool = True, seed: int = 0) -> DataFrame:
    """payload -> payload_id, strand_idx, dna. Indexes keep their top bit for virtual segments. A payload's segments meet in one group: cut very large payloads."""
    segs = segments(payload, capacity, index_bits, redundancy)

    def run(key, table):
        rows = table.sort_by("seg_idx")["bits"].to_pylist()
        strands = _pair_up(rows, index_bits, number, max_run, gc, seed)
        return pa.table({"payload_id": pa.array([key[0].as_py()] * len(strands), pa.int64()), "strand_idx": pa.array(np.arange(len(strands)), pa.int32()), "dna": pa.array(strands)})

    return segs.groupBy("payload_id").applyInArrow(run, "payload_id long, strand_idx int, dna string")


def decode(strand: DataFrame, sizes: DataFrame, index_bits: int = 16, number: int = 1, redundancy: bool = True) -> DataFrame:
    """strand (payload_id, dna), sizes (payload_id, n_bits) -> payload_id, content, n_lost, n_repaired. Virtual segments go by their index."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([list(separate(x or "", number) or ()) for x in column.to_pylist()], pa.list_(pa.string()))

    found = strand.select("payload_id", F.explode(F.arrow_udf(run, "array<string>")("dna")).alias("bits")).filter(F.left("bits", F.lit(1)) == "0")
    return repair_segments(found, sizes, index_bits, redundancy).select("payload_id", bits.bits_to_bytes(F.col("bits")).alias("content"), "n_lost", "n_repaired")
