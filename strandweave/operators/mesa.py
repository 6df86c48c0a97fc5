"""Profile-driven mutation engine: insertions, mismatches and deletions at homopolymer runs or random places."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from ..plans.profiles import SEQUENCING, SYNTHESIS, Profile
from .channels import BASES, EDITS, _edited, _with_rng, copies

RUN = re.compile(r"A{3,}|C{3,}|G{3,}|T{3,}")


def _pick(g: np.random.Generator, weights: dict[str, float], allowed: set[str]) -> str | None:
    names = [b for b in sorted(weights) if b in allowed and weights[b] > 0]
    if not names:
        return None
    p = np.array([weights[b] for b in names])
    return names[int(np.searchsorted(np.cumsum(p / p.sum()), g.random(), "right").clip(0, len(names) - 1))]


def _place(g: np.random.Generator, seq: str, runs_share: float, bases: dict[str, float]) -> int | None:
    """A position: in a run of three or more equal bases with its share (if there is one), else of a weighted base."""
    if g.random() < runs_share:
        runs = [m.span() for m in RUN.finditer(seq)]
        base = _pick(g, bases, {seq[a] for a, _ in runs})
        if base:
            own = [(a, b) for a, b in runs if seq[a] == base]
            a, b = own[g.integers(len(own))]
            return int(g.integers(a, b))
    base = _pick(g, bases, set(seq))
    if base is None:
        return None
    own = [i for i, b in enumerate(seq) if b == base]
    return own[g.integers(len(own))]


def mutate(g: np.random.Generator, seq: str, profile: Profile, span: tuple[int, int] | None = None) -> tuple[str, list]:
    """Edits refer to positions of the original; a position is edited once. span limits where (first, last + 1)."""
    lo, hi = span or (0, len(seq))
    part, n = seq[lo:hi], hi - lo
    done: dict[int, tuple] = {}
    if n == 0:
        return seq, []
    hits = {k: int(g.binomial(n, min(1.0, profile.raw_rate * share))) for k, share in (("insertion", profile.insertion), ("mismatch", profile.mismatch), ("deletion", profile.deletion))}
    for _ in range(hits["insertion"]):
        at = _place(g, part, profile.insertion_runs, profile.insertion_bases)
        if at is not None and at not in done:
            done[at] = ("insertion", at + lo, "", BASES[g.integers(4)])
    for _ in range(hits["mismatch"]):
        if not profile.swaps:
            at = int(g.integers(n))
            if at not in done:
                done[at] = ("mismatch", at + lo, part[at], BASES[g.integers(4)])
            continue
        for motif in sorted(profile.swaps, key=lambda m: (-len(m), m)):
            places = [m.start() for m in re.finditer(f"(?={motif})", part)]
            if len(profile.swaps) > 1 and all(len(m) == 1 for m in profile.swaps):
                places = [i for i, b in enumerate(part) if b in profile.swaps]
            if places:
                at = places[g.integers(len(places))]
                motif = motif if part.startswith(motif, at) else part[at]
                new = _pick(g, profile.swaps[motif], set(profile.swaps[motif]))
                changed = [j for j, (x, y) in enumerate(zip(motif, new, strict=True)) if x != y]
                if not any(at + j in done for j in changed):
                    for j in changed:
                        done[at + j] = ("mismatch", at + j + lo, motif[j], new[j])
                break
    for _ in range(hits["deletion"]):
        at = _place(g, part, profile.deletion_runs, profile.deletion_bases)
        if at is not None and at not in done:
            done[at] = ("deletion", at + lo, part[at], "")
    out, last = [], 0
    for at in sorted(done):
        mode, pos, orig, mod = done[at]
        out.append(seq[last:pos])
        out.append(mod + seq[pos] if mode == "insertion" else mod)
        last = pos + 1
    out.append(seq[last:])
    return "".join(out), [done[a] for a in sorted(done)]


def mutate_reads(reads: DataFrame, profile: Profile, seed: int = 0, span: tuple[int, int] | None = None) -> DataFrame:
    """reads with mutated STRUCT<seq, edits>."""
    return reads.withColumn("mutated", _with_rng(lambda g, s: mutate(g, s, profile, span), seed, EDITS, _edited)("dna", "payload_id", "strand_idx", "copy_no"))


def synthesis(strand: DataFrame, profile_id: int = 68, mean: float = 10, std: float = 2, seed: int = 0) -> DataFrame:
    if profile_id not in SYNTHESIS:
        raise ValueError(f"no synthesis profile {profile_id}")
    return mutate_reads(copies(strand, mean, std, seed), SYNTHESIS[profile_id], seed + 1)


def sequencing(reads: DataFrame, profile_id: int = 38, seed: int = 0) -> DataFrame:
    if profile_id not in SEQUENCING:
        raise ValueError(f"no sequencing profile {profile_id}")
    return mutate_reads(reads, SEQUENCING[profile_id], seed)


def pcr(reads: DataFrame, profile: Profile, cycles: int, seed: int = 0) -> DataFrame:
    return mutate_reads(reads, profile.scaled(cycles), seed)


def aging(reads: DataFrame, profile: Profile, months: float, seed: int = 0) -> DataFrame:
    return mutate_reads(reads, profile.scaled(months), seed)
