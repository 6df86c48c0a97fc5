"""Sequence quality: interval finders, error curves, lineage islands, FASTQ. Finders give read_id, kind, startpos, endpos, errorprob."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits, nt

#: Error probability of homopolymer runs by length; longer runs are certain. Fixed values.
RUN_PROB = {3: 0.3, 4: 0.6, 5: 0.9}


def homopolymers(reads: DataFrame, seq: str = "seq", least: int = 3) -> DataFrame:
    """Runs of at least `least` equal bases: read_id, base, startpos, endpos (both inclusive, from 0), errorprob.

    Runs tile a strand, so starts are running sums of lengths; no base is exploded.
    """
    lens = F.transform(nt.runs(F.col(seq)), lambda x: F.struct(F.left(x, F.lit(1)).alias("base"), F.char_length(x).alias("n")))
    one = reads.select("read_id", F.posexplode(lens).alias("i", "r")).select("read_id", "i", "r.base", "r.n")
    upto = F.sum("n").over(Window.partitionBy("read_id").orderBy("i"))
    prob = F.when(F.col("n") > max(RUN_PROB), F.lit(1.0))
    for k, p in RUN_PROB.items():
        prob = prob.when(F.col("n") == k, F.lit(p))
    return one.withColumn("endpos", (upto - 1).cast("int")).filter(F.col("n") >= least).select("read_id", "base", (F.col("endpos") - F.col("n") + 1).cast("int").alias("startpos"), "endpos", prob.otherwise(F.lit(0.0)).alias("errorprob"))


def gc_error(gc: Column) -> Column:
    """gc as a fraction. None from 0.5 to 0.6; 2.5 for each unit below, 2 for each above; at most 1."""
    return F.least(F.lit(1.0), F.when(gc < 0.5, (0.5 - gc) * 2.5).when(gc > 0.6, (gc - 0.6) * 2.0).otherwise(F.lit(0.0)))


def gc_windows(reads: DataFrame, width: int, seq: str = "seq") -> DataFrame:
    """Tumbling windows over positions: read_id, startpos, endpos, gc, errorprob."""
    w = reads.select("read_id", F.posexplode(bits.pieces(F.col(seq), width)).alias("i", "w")).select("read_id", (F.col("i") * width).alias("startpos"), "w")
    gc = nt.gc_fraction(F.col("w"))
    return w.select("read_id", "startpos", (F.col("startpos") + F.char_length("w") - 1).alias("endpos"), gc.alias("gc"), gc_error(gc).alias("errorprob"))


def overall_gc(reads: DataFrame, seq: str = "seq") -> DataFrame:
    gc = nt.gc_fraction(F.col(seq))
    return reads.select("read_id", F.lit(0).alias("startpos"), (F.char_length(seq) - 1).alias("endpos"), gc.alias("gc"), gc_error(gc).alias("errorprob"))


def kmer_counts(reads: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    return reads.select(F.explode(nt.kmers(F.col(seq), k)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


def repeated_kmers(reads: DataFrame, k: int, more_than: int = 1, seq: str = "seq") -> DataFrame:
    """k-mers a read has more than `more_than` times: read_id, kmer, n, startpos (each place), endpos, errorprob n^2 * 2e-6."""
    at = reads.select("read_id", F.posexplode(nt.kmers(F.col(seq), k)).alias("startpos", "kmer"))
    grouped = at.groupBy("read_id", "kmer").agg(F.count("*").alias("n"), F.collect_list("startpos").alias("at")).filter(F.col("n") > more_than)
    prob = F.least(F.lit(1.0), F.col("n") * F.col("n") * 2e-6)
    return grouped.select("read_id", "kmer", "n", F.explode("at").alias("startpos")).select("read_id", "kmer", "n", "startpos", (F.col("startpos") + k - 1).alias("endpos"), prob.alias("errorprob"))


def motif_hits(reads: DataFrame, motifs: DataFrame, seq: str = "seq") -> DataFrame:
    """Every place, overlapping ones too, of each motif (motif, errorprob): read_id, motif, startpos, endpos, errorprob.

    Motif lengths are few, so k-mers of those lengths meet the motifs in an
    equi-join with a broadcast dimension.
    """
    sizes = sorted(r[0] for r in motifs.select(F.char_length("motif")).distinct().collect())
    found = None
    for k in sizes:
        at = reads.select("read_id", F.posexplode(nt.kmers(F.col(seq), k)).alias("startpos", "motif"))
        hit = at.join(F.broadcast(motifs.filter(F.char_length("motif") == k)), "motif").select("read_id", "motif", "startpos", (F.col("startpos") + k - 1).alias("endpos"), "errorprob")
        found = hit if found is None else found.unionByName(hit)
    return found


def stacked(intervals: DataFrame, cap: float = 1.0) -> DataFrame:
    """Per read and position the sum of the intervals' probabilities, at most cap: read_id, pos, prob."""
    at = intervals.select("read_id", F.explode(F.sequence("startpos", "endpos")).alias("pos"), "errorprob")
    return at.groupBy("read_id", "pos").agg(F.least(F.lit(cap), F.sum("errorprob")).alias("prob"))


def segments_of(profile: DataFrame) -> DataFrame:
    """Maximal stretches of one probability in a stacked profile: read_id, startpos, endpos, prob."""
    w = Window.partitionBy("read_id", "prob").orderBy("pos")
    return profile.withColumn("g", F.col("pos") - F.row_number().over(w)).groupBy("read_id", "prob", "g").agg(F.min("pos").alias("startpos"), F.max("pos").alias("endpos")).select("read_id", "startpos", "endpos", "prob")


def islands(intervals: DataFrame) -> DataFrame:
    """Intervals that overlap, directly or through others: read_id, startpos, endpos, n."""
    w = Window.partitionBy("read_id").orderBy("startpos", "endpos")
    before = F.max("endpos").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.withColumn("new", F.when(F.col("startpos") <= before, 0).otherwise(1))
    return marked.withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("read_id", "g").agg(F.min("startpos").alias("startpos"), F.max("endpos").alias("endpos"), F.count("*").alias("n")).drop("g")


def phred(p: Column, odds: bool = False) -> Column:
    """Quality of an error probability, clamped to 0..40, as a character from '!'."""
    q = -10 * F.log10(p / (1 - p)) if odds else -10 * F.log10(p)
    q = F.when(p <= 0, 40.0).when(p >= 1, 0.0).otherwise(q)
    return F.char((33 + F.least(F.greatest(F.round(q), F.lit(0)), F.lit(40))).cast("int"))


def fastq_quality(reads: DataFrame, profile: DataFrame, seq: str = "seq") -> DataFrame:
    """reads with quality: a character per base from the stacked profile; positions without a probability get the best."""
    got = profile.groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("pos", "prob"))).alias("p"))
    # Positions from 0 on without a gap are found by their place; a search is for others.
    at = lambda i: bits.let(F.get("p", i), lambda x: F.when(x["pos"] == i, x["prob"]).otherwise(F.get(F.filter("p", lambda y: y["pos"] == i), F.lit(0))["prob"]))
    chars = F.transform(F.sequence(F.lit(0), F.char_length(seq) - 1), lambda i: phred(F.coalesce(at(i), F.lit(0.0))))
    # A profile is larger than its estimate from the reads' file says: it must not be broadcast.
    return reads.join(got.hint("merge"), "read_id", "left").withColumn("quality", F.when(F.char_length(seq) > 0, F.array_join(chars, "")).otherwise(F.lit(""))).drop("p")


def curve(points: list[tuple[float, float]], x: Column, smooth: bool = False) -> Column:
    """Interpolated probability curve, clamped at the ends and to 0..1; smooth is a monotone cubic.

    Coefficients are worked out on the driver; equal x keep the first point.
    """
    seen: dict[float, float] = {}
    for a, b in sorted(points, key=lambda p: p[0]):
        seen.setdefault(round(a, 6), b)
    xs, ys = list(seen), list(seen.values())
    if len(xs) == 1:
        return F.lit(min(1.0, max(0.0, ys[0])))
    h = [b - a for a, b in zip(xs, xs[1:], strict=False)]
    d = [(b - a) / w for a, b, w in zip(ys, ys[1:], h, strict=False)]
    m = _tangents(d) if smooth else [*d, d[-1]]
    out = F.when(x <= xs[0], F.lit(ys[0]))
    for i, w in enumerate(h):
        t = (x - xs[i]) / w
        if smooth:
            y = (2 * t * t * t - 3 * t * t + 1) * ys[i] + (t * t * t - 2 * t * t + t) * (w * m[i]) + (3 * t * t - 2 * t * t * t) * ys[i + 1] + (t * t * t - t * t) * (w * m[i + 1])
        else:
            y = F.lit(ys[i]) + t * (ys[i + 1] - ys[i])
        out = out.when(x <= xs[i + 1], y)
    return F.least(F.greatest(out.otherwise(F.lit(ys[-1])), F.lit(0.0)), F.lit(1.0))


def _tangents(d: list[float]) -> list[float]:
    """Tangents that keep a cubic monotone between its points."""
    m = [d[0], *[(a + b) / 2 if a * b > 0 else 0.0 for a, b in zip(d, d[1:], strict=False)], d[-1]]
    for i, s in enumerate(d):
        if s == 0:
            m[i] = m[i + 1] = 0.0
        else:
            a, b = m[i] / s, m[i + 1] / s
            if a * a + b * b > 9:
                f = 3 / (a * a + b * b) ** 0.5
                m[i], m[i + 1] = f * a * s, f * b * s
    return m


def apply_edits(reads: DataFrame, seq: str = "dna") -> DataFrame:
    """reads with mutated.edits -> rebuilt: the original with its edits applied; equals mutated.seq."""
    return reads.withColumn("rebuilt", F.arrow_udf(_rebuilt, "string")(seq, "mutated.edits"))


def _rebuilt(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Strands with their edits applied: only places with an edit are touched. At a place insertions come first, in their order, then the base, its first replacement, or nothing."""
    for seqs, lists in batches:
        edits = lists.flatten()
        ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)))).tolist()
        mode, pos, mod = (edits.field(f).to_pylist() for f in ("mode", "pos", "mod"))
        whole = pc.is_valid(lists).to_pylist()
        out = []
        for r, s in enumerate(seqs.to_pylist()):
            if not s or not whole[r]:
                out.append("")
                continue
            pieces, done = [], 0
            order = sorted((j for j in range(ends[r], ends[r + 1]) if pos[j] is not None and 0 <= pos[j] < len(s)), key=lambda j: pos[j])
            i = 0
            while i < len(order):
                p = pos[order[i]]
                pieces.append(s[done:p])
                gone, new = False, None
                while i < len(order) and pos[order[i]] == p:
                    j = order[i]
                    if mode[j] == "insertion":
                        pieces.append(mod[j] or "")
                    elif mode[j] == "deletion":
                        gone = True
                    elif mode[j] == "mismatch" and new is None:
                        new = mod[j]
                    i += 1
                pieces.append("" if gone else s[p] if new is None else new)
                done = p + 1
            out.append("".join([*pieces, s[done:]]))
        yield pa.array(out, pa.string())
