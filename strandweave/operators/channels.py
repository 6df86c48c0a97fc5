"""Synthesis, storage, handling and sequencing channels over read tables.

Row decisions (copies, survival) and substitutions are Catalyst expressions over
hash uniforms; channels that change lengths are Arrow UDFs whose generators are
keyed by the read's identity. All give the same rows under any partitioning.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits, digests, rng
from ..functions.kernels import column_of, flat
from ..scratch import running_total

BASES = "ACGT"
#: Decay per base and year. Fixed values.
DECAY = {"biogene": 1e-7, "newstorage": 1e-8, "permafrost": 5.5e-6, "roomtemperature": 0.00133}
#: Substitution matrices of the position-dependent channels: the chance to stay, and of each other base. Fixed values.
ILLUMINA_STAY, NANOPORE_STAY, COMPAT_ILLUMINA_C_STAY = 0.997, 0.85, 0.007


def copies(strand: DataFrame, mean: float, std: float, seed: int = 0) -> DataFrame:
    """Each strand max(1, int(N(mean, std))) times, with copy_no from 0."""
    n = F.greatest(F.lit(1), (F.lit(float(mean)) + F.lit(float(std)) * rng.normal(seed, "copies", F.col("payload_id"), F.col("strand_idx"))).cast("int"))
    return strand.withColumn("copy_no", F.explode(F.sequence(F.lit(0), n - 1)))


def most_copies(mean: float, std: float) -> int:
    """What copies() makes of a strand at most: the draw of a normal from 32 bits ends at sqrt(64 ln 2)."""
    return max(1, math.floor(mean + abs(std) * math.sqrt(64 * math.log(2))))


def survival(length: Column, years: float, decay: float) -> Column:
    return F.pow(F.lit(1 - decay), length * F.lit(float(years)))


def store(reads: DataFrame, condition: str, years: float, seed: int = 0, seq: str = "dna") -> DataFrame:
    """The reads that outlive the years; one break loses the strand."""
    u = rng.uniform(seed, "store", condition, *[F.col(c) for c in ("payload_id", "strand_idx", "copy_no")])
    return reads.filter(u > 1 - survival(F.char_length(seq), years, DECAY[condition]))


def strand_breaks(reads: DataFrame, condition: str, years: float, seed: int, *by: str) -> DataFrame:
    """by, n_broken, n_strands: how many strands store() loses of each group."""
    u = rng.uniform(seed, "store", condition, *[F.col(c) for c in ("payload_id", "strand_idx", "copy_no")])
    broken = ~(u > 1 - survival(F.char_length("dna"), years, DECAY[condition]))
    return reads.groupBy(*by).agg(F.count_if(broken).alias("n_broken"), F.count("*").alias("n_strands"))


def ensure_survivors(reads: DataFrame) -> DataFrame:
    """reads, or an error where storage has left none."""
    if reads.isEmpty():
        raise ValueError("all strands have decayed")
    return reads


def store_chain(reads: DataFrame, stages: list[tuple[str, float]], seed: int = 0, seq: str = "dna") -> DataFrame:
    """Stages one after another. Decisions are independent, so all filters run in one pass."""
    return reduce(lambda df, s: store(df, s[1][0], s[1][1], seed + s[0], seq), enumerate(stages), reads)


def random_storage(reads: DataFrame, seed: int = 0, per: int = 460) -> DataFrame:
    """ceil(length / per) substitutions at hash-drawn places, to another base."""
    key = [F.col(c) for c in ("payload_id", "strand_idx", "copy_no")]
    n = F.char_length("dna")

    def step(s: Column, j: Column) -> Column:
        at = (F.floor(rng.fast_uniform(F.lit(seed), F.lit("place"), *key, j) * n) + 1).cast("int")
        old = F.instr(F.lit(BASES), F.substring(s, at, F.lit(1)))
        new = F.substring(F.lit(BASES), (F.pmod(old - 1 + 1 + F.floor(rng.fast_uniform(F.lit(seed), F.lit("base"), *key, j) * 3), F.lit(4)) + 1).cast("int"), F.lit(1))
        return F.overlay(s, new, at, F.lit(1))

    return reads.withColumn("dna", F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.ceil(n / per).cast("int")), F.col("dna"), step)).otherwise(F.col("dna")))


def _per_base(seq: Column, change: Callable[[Column, Column], Column]) -> Column:
    """Each base by change(base, position from 1); no bases, no change."""
    return F.array_join(F.transform(bits.chars(seq), lambda b, i: change(b, i + 1)), "")


def substitute_iid(reads: DataFrame, rate: float, seed: int = 0, distinct: bool = False, exact: bool = True) -> DataFrame:
    """With the rate, a uniform base (which may be the same), or with distinct one of the other three. Adds n_changed.

    exact draws by md5, which has an SQL twin; otherwise by xxhash64.
    """
    key = [F.col(c) for c in ("payload_id", "strand_idx", "copy_no")]
    if exact:
        kernel = F.arrow_udf(_substituted(rate, distinct), "struct<read:string,n_changed:int>")
        made = kernel("dna", *[F.concat_ws("|", F.lit(str(seed)), F.lit(what), *[k.cast("string") for k in key]) for what in ("hit", "base")])
        return reads.withColumn("__s", made).withColumn("read", F.col("__s.read")).withColumn("n_changed", F.col("__s.n_changed")).drop("__s")
    draw = lambda what, i: rng.fast_uniform(F.lit(seed), F.lit(what), *key, i)

    def change(base: Column, i: Column) -> Column:
        u = draw("base", i)
        if distinct:
            other = F.replace(F.lit(BASES), base, F.lit(""))
            new = F.substring(other, (F.floor(u * 3) + 1).cast("int"), F.lit(1))
        else:
            new = F.substring(F.lit(BASES), (F.floor(u * 4) + 1).cast("int"), F.lit(1))
        return F.when(draw("hit", i) < rate, new).otherwise(base)

    changed = reads.withColumn("read", _per_base(F.col("dna"), change))
    return changed.withColumn("n_changed", F.size(bits.diff_positions(F.col("dna"), F.col("read"))))


#: Reads that one pass of a kernel works on: their arrays stay small whatever a batch holds.
READS = 2000


def _substituted(rate: float, distinct: bool) -> Callable:
    """STRUCT<read, n_changed> of (dna, prefix of the draws of hits, of bases); draws are those of rng.uniform over prefix and place."""
    letters = np.frombuffer(BASES.encode(), np.uint8)
    others = np.tile(letters[:3], (256, 1))  # of any other letter the first three
    for b in BASES:
        others[ord(b)] = list(BASES.replace(b, "").encode())
    picks = 3 if distinct else 4

    def by_rows(seqs: pa.Array, hits: list[bytes], bases: list[bytes]) -> tuple[list, list]:
        """The same a character at a time, where some aren't one byte."""
        out, n = [], []
        for s, h, b in zip(seqs.to_pylist(), hits, bases, strict=True):
            new = list(s or "")
            for i, x in enumerate(new, 1):
                if digests.head(h + b"|%d" % i) / 2**32 < rate:
                    other = BASES.replace(x, "") if distinct else BASES
                    new[i - 1] = other[int(digests.head(b + b"|%d" % i) / 2**32 * picks)]
            out.append(None if s is None else "".join(new))
            n.append(None if s is None else sum(x != y for x, y in zip(s, new, strict=True)))
        return out, n

    def part(seqs: pa.Array, hits: pa.Array, bases: pa.Array) -> pa.Array:
        data, bounds, valid = flat(seqs)
        size, at_hit, at_base = np.diff(bounds), [x.encode() for x in hits.to_pylist()], [x.encode() for x in bases.to_pylist()]
        if (data >= 128).any():
            out, n = by_rows(seqs, at_hit, at_base)
            return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(n, pa.int32())], names=["read", "n_changed"])
        hit = np.flatnonzero(digests.heads(at_hit, size) / 2.0**32 < rate)
        row = np.searchsorted(bounds, hit, "right") - 1
        if len(hit) * 8 > len(data):
            u = digests.heads(at_base, size)[hit]
        else:
            u = np.array([digests.head(at_base[r] + b"|%d" % i) for r, i in zip(row.tolist(), (hit - bounds[row] + 1).tolist(), strict=True)], np.uint32)
        pick = (u / 2.0**32 * picks).astype(np.int64)
        new = data.copy()
        new[hit] = others[data[hit], pick] if distinct else letters[pick]
        n = np.bincount(row[new[hit] != data[hit]], minlength=len(size))
        return pa.StructArray.from_arrays([column_of(new, bounds, valid, pa.string()), pa.array(n, pa.int32(), mask=None if valid is None else ~valid)], names=["read", "n_changed"])

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in batches:
            yield pa.concat_arrays([part(*[c.slice(i, READS) for c in columns]) for i in range(0, max(1, len(columns[0])), READS)])

    return run


def substitute_by_position(reads: DataFrame, stay: float, seed: int = 0, slope: float = 0.01, compat_c: bool = False) -> DataFrame:
    """Position-dependent substitutions: at position p (from 0) of n with chance slope * p / n a base is drawn anew, itself with `stay`.

    compat_c gives C the low chance to stay that the published matrix has.
    """
    key = [F.col(c) for c in ("payload_id", "strand_idx", "copy_no")]
    n = F.char_length("dna")

    def change(base: Column, i: Column) -> Column:
        u = rng.uniform(seed, "base", *key, i)
        # Rows of the matrix: `stay` and 0.001 (or 0.05) for each other base, renormalised.
        off = 0.001 if stay > 0.9 else 0.05
        chance = lambda s: s / (s + 3 * off)
        own = F.when(base == "C", chance(COMPAT_ILLUMINA_C_STAY)).otherwise(chance(stay)) if compat_c else F.lit(chance(stay))
        others = F.replace(F.lit(BASES), base, F.lit(""))
        drawn = F.when(u < own, base).otherwise(F.substring(others, F.least(F.floor((u - own) / (1 - own) * 3) + 1, F.lit(3)).cast("int"), F.lit(1)))
        return F.when(rng.uniform(seed, "hit", *key, i) < F.lit(slope) * (i - 1) / n, drawn).otherwise(base)

    return reads.withColumn("read", _per_base(F.col("dna"), change))


def _with_rng(fn: Callable[[np.random.Generator, str], tuple[str, list]], seed: int, kind: str, make: Callable[[list], pa.Array]):
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for seqs, *keys in batches:
            ids = list(zip(*[k.to_pylist() for k in keys], strict=True))
            yield make([fn(rng.counters(seed, *[hash_id(x) for x in i]), s or "") for s, i in zip(seqs.to_pylist(), ids, strict=True)])

    return F.arrow_udf(run, kind)


def hash_id(x) -> int:
    return -1 if x is None else int(x)


def _strings(rows: list) -> pa.Array:
    return pa.array([r[0] for r in rows], pa.string())


_EDIT = pa.struct([("mode", pa.string()), ("pos", pa.int32()), ("orig", pa.string()), ("mod", pa.string())])
MODES = ["insertion", "deletion", "mismatch"]
EDITS = "struct<seq:string,edits:array<struct<mode:string,pos:int,orig:string,mod:string>>>"


def _edited(rows: list) -> pa.Array:
    edits = pa.array([[dict(zip(("mode", "pos", "orig", "mod"), e, strict=True)) for e in r[1]] for r in rows], pa.list_(_EDIT))
    return pa.StructArray.from_arrays([_strings(rows), edits], names=["seq", "edits"])


def indel(g: np.random.Generator, seq: str, p_ins: float, p_del: float, p_sub: float, slope: bool = False) -> tuple[str, list]:
    """Per original base: an insertion before it, then deletion or substitution. Edits refer to original positions."""
    out, edits, n = [], [], len(seq)
    u = g.random((n, 3))
    for i, b in enumerate(seq):
        if u[i, 0] < p_ins:
            x = BASES[g.integers(4)]
            edits.append(("insertion", i, "", x))
            out.append(x)
        if u[i, 1] < p_del:
            edits.append(("deletion", i, b, ""))
            continue
        if u[i, 2] < p_sub * (i / n if slope else 1):
            x = BASES.replace(b, "")[g.integers(3)]
            edits.append(("mismatch", i, b, x))
            b = x
        out.append(b)
    return "".join(out), edits


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def indel_batch(data: np.ndarray, bounds: np.ndarray, keys: np.ndarray, p_ins: float, p_del: float, p_sub: float, slope: bool = False, window: tuple[np.ndarray, int] | None = None, edits: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array | None]:
    """indel() for a whole batch: bytes and bounds of the reads, a 64-bit key each -> bytes, bounds and edits (unless not wanted) of the mutated ones. With a window (each read's first place, and the width) only there.

    Every draw is a hash of the read's key and the base's place.
    """
    if not len(data):
        return data, bounds, _edit_lists(np.zeros(len(bounds), np.int32), *(np.zeros(0, t) for t in (np.int8, np.int32, np.uint8, np.uint8)))
    size, low = np.diff(bounds), np.uint64(0xFFFFFFFF)
    # A base's key is its read's and its place's: numbers in the batch less that of the read's first base.
    base_key = np.repeat(keys - bounds[:-1].astype(np.uint64) * _STEP, size)
    base_key += np.arange(len(data), dtype=np.uint64) * _STEP
    two = _mixed(base_key ^ np.uint64(0xD1B54A32D192ED03))
    one = _mixed(base_key)
    # Events are few: all but their draws is for them only.
    ins, gone, sub = _below(one >> np.uint64(32), p_ins), _below(one & low, p_del), _below(two >> np.uint64(32), p_sub)
    read = lambda at: np.searchsorted(bounds, at, "right") - 1
    if window is not None:
        inside = lambda at: at[(at - bounds[read(at)] >= window[0][read(at)]) & (at - bounds[read(at)] < window[0][read(at)] + window[1])]
        ins, gone, sub = inside(ins), inside(gone), inside(sub)
    if slope:
        r = read(sub)
        sub = sub[(two[sub] >> np.uint64(32)).astype(np.float64) < p_sub * (sub - bounds[r]) / size[r] * 2.0**32]
    sub = sub[~np.isin(sub, gone)]
    letters = np.frombuffer(BASES.encode(), np.uint8)
    code = np.zeros(256, np.uint8)
    code[letters] = range(4)
    extra = letters[(two[ins] & np.uint64(3)).astype(np.int64)]
    other = letters[(code[data[sub]] + 1 + ((two[sub] >> np.uint64(2)) & low) % np.uint64(3)).astype(np.int64) & 3]
    out = data.copy()
    out[sub] = other
    if len(ins):
        out = np.insert(out, ins, extra)
    if len(gone):
        out = np.delete(out, gone + np.searchsorted(ins, gone, "right"))
    upto = bounds + np.searchsorted(ins, bounds) - np.searchsorted(gone, bounds)
    if not edits:
        return out, upto, None
    at = np.concatenate((ins, gone, sub))
    mode = np.repeat(np.arange(3), (len(ins), len(gone), len(sub)))
    mod = np.concatenate((extra, data[gone], other))
    order = np.lexsort((mode, at))
    at, mode, mod = at[order], mode[order], mod[order]
    ends = np.searchsorted(at, bounds).astype(np.int32)
    return out, upto, _edit_lists(ends, mode, at - bounds[read(at)], data[at], mod)


#: What a base's key grows by from place to place.
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _below(draws: np.ndarray, p: float) -> np.ndarray:
    """Where draws of 32 bits are below a chance."""
    return np.flatnonzero(draws < np.uint64(min(max(0, math.ceil(p * 2.0**32)), 2**32)))


def _edit_lists(ends: np.ndarray, mode: np.ndarray, pos: np.ndarray, orig: np.ndarray, mod: np.ndarray) -> pa.Array:
    """Edits of reads in their order as lists; ends: offsets of the reads. mode: 0 insertion, 1 deletion, 2 mismatch; orig and mod are bytes."""
    modes = pa.DictionaryArray.from_arrays(pa.array(mode, pa.int8()), MODES).cast(pa.string())

    def base(x: np.ndarray, keep: np.ndarray) -> pa.Array:
        return column_of(x[keep], np.concatenate(([0], np.cumsum(keep))), None, pa.string())

    pieces = [modes, pa.array(pos, pa.int32()), base(orig, mode > 0), base(mod, mode != 1)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(pieces, fields=list(_EDIT)))


def channel_indel(reads: DataFrame, p_ins: float, p_del: float, p_sub: float, seed: int = 0, slope: bool = False) -> DataFrame:
    """reads with mutated STRUCT<seq, edits>, vectorised over batches. Illumina: 1e-6, 1e-6, sloped 0.01; nanopore: 0.01, 0.01, sloped 0.01."""

    return _mutated(reads, "indel", seed, lambda data, bounds, keys: indel_batch(data, bounds, keys, p_ins, p_del, p_sub, slope))


def indel_seqs(reads: DataFrame, p_ins: float, p_del: float, p_sub: float, seed: int = 0, slope: bool = False) -> DataFrame:
    """reads with seq, the sequence that channel_indel gives, without its edits."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for seqs, keys in batches:
            parts = []
            for i in range(0, max(1, len(seqs)), READS):
                data, bounds, _ = flat(seqs.slice(i, READS))
                part = _mixed(keys.slice(i, READS).to_numpy(zero_copy_only=False).view(np.uint64))
                parts.append(column_of(*indel_batch(data, bounds, part, p_ins, p_del, p_sub, slope, edits=False)[:2], None, pa.string()))
            yield pa.concat_arrays(parts)

    # Filters on the sequence must not make it once more below them.
    return reads.withColumn("seq", F.arrow_udf(run, "string").asNondeterministic()(F.coalesce(F.col("dna"), F.lit("")), _read_key(seed, "indel")))


def _read_key(seed: int, what: str) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(what), "payload_id", "strand_idx", "copy_no")


def _mutated(reads: DataFrame, what: str, seed: int, fn: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, pa.Array]]) -> DataFrame:
    """reads with mutated STRUCT<seq, edits> by fn(bytes, bounds, a 64-bit key for each read) -> bytes, bounds and edits, READS reads at a time."""

    def part(seqs: pa.Array, keys: pa.Array) -> pa.Array:
        data, bounds, _ = flat(seqs)
        out, ends, edits = fn(data, bounds, _mixed(keys.to_numpy(zero_copy_only=False).view(np.uint64)))
        return pa.StructArray.from_arrays([column_of(out, ends, None, pa.string()), edits], names=["seq", "edits"])

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for seqs, keys in batches:
            yield pa.concat_arrays([part(seqs.slice(i, READS), keys.slice(i, READS)) for i in range(0, max(1, len(seqs)), READS)])

    return reads.withColumn("mutated", F.arrow_udf(run, EDITS)(F.coalesce(F.col("dna"), F.lit("")), _read_key(seed, what)))


def homopolymer_slips(reads: DataFrame, rate: float, seed: int = 0) -> DataFrame:
    """Scan for four equal bases; with the rate lose one of them and step back two."""

    def slip(g: np.random.Generator, seq: str) -> tuple[str, list]:
        s, i = seq, 0
        while i + 4 <= len(s):
            if s[i] == s[i + 1] == s[i + 2] == s[i + 3] and g.random() < rate:
                s = s[:i] + s[i + 1 :]
                i = max(0, i - 2)
            else:
                i += 1
        return s, []

    return reads.withColumn("read", _with_rng(slip, seed, "string", _strings)("dna", "payload_id", "strand_idx", "copy_no"))


EVENTS = ("Ins", "Del", "Sub", "Tra")


def _contexts(data: np.ndarray, bounds: np.ndarray, table: dict, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(which, levels): for every base a row of levels, (contexts, event before, event): running chances of the events.

    Bases are taken together by their context as text, so a table is looked up once for each text and event before.
    """
    radius, befores = k // 2, (*EVENTS, "Beg")

    def rows(context: str) -> list[np.ndarray]:
        found = [np.array(table.get((context, b)) or table.get(("", b)) or table[("", "")], float) for b in befores]
        return [np.cumsum(p / p.sum()) for p in found]

    if not any(c for c, _ in table):
        return np.zeros(len(data), np.int64), np.array([rows("")])
    size = np.diff(bounds)
    # Every read with `radius` zero bytes on both sides.
    shift = np.repeat((2 * np.arange(len(size)) + 1) * radius, size)
    wide = np.zeros(len(data) + 2 * radius * len(size), np.uint8)
    at = np.arange(len(data)) + shift
    wide[at] = data
    windows = np.stack([wide[at + j] for j in range(-radius, radius + 1)], axis=1)
    texts, which = np.unique(np.ascontiguousarray(windows).view(f"V{2 * radius + 1}").reshape(-1), return_inverse=True)
    return which.reshape(-1), np.array([rows(t.tobytes().replace(b"\0", b"").decode("latin-1")) for t in texts]).reshape(-1, len(befores), 4)


def markov_batch(data: np.ndarray, bounds: np.ndarray, keys: np.ndarray, table: dict, substitution: dict, k: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """k-mer context and the event before decide between Ins, Del, Sub and Tra; an insertion consumes no base.

    All reads of a batch go one event on at a time; a draw is a hash of the read's key and the event's number.
    """
    which, levels = _contexts(data, bounds, table, k)
    letters, low = np.frombuffer(BASES.encode(), np.uint8), np.uint64(0xFFFFFFFF)
    swaps = np.zeros((256, 4))
    for b in range(256):
        q = np.array([w if x != chr(b) else 0.0 for x, w in zip(BASES, substitution.get(chr(b), (1, 1, 1, 1)), strict=True)], float)
        swaps[b] = np.cumsum(q / q.sum()) if q.sum() else 1.0
    at, last = bounds[:-1].copy(), np.full(len(bounds) - 1, 4)
    live, step, trail = np.flatnonzero(np.diff(bounds) > 0), 0, []
    while len(live):
        here = at[live]
        h = _mixed(keys[live] + np.uint64((step + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        u, v = (h >> np.uint64(32)) / 2.0**32, (h & low) / 2.0**32
        event = np.minimum((levels[which[here], last[live]] <= u[:, None]).sum(axis=1), 3)
        own = data[here]
        swapped = letters[np.minimum((swaps[own] <= v[:, None]).sum(axis=1), 3)]
        new = np.where(event == 0, letters[(v * 4).astype(np.int64)], np.where(event == 2, swapped, own))
        trail.append((live, event, here, new))
        last[live] = event
        at[live] = here + (event != 0)
        live, step = live[at[live] < bounds[live + 1]], step + 1
    if not trail:
        trail.append((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)))
    read, event, here, new = (np.concatenate([t[j] for t in trail]) for j in range(4))
    order = np.argsort(read, kind="stable")
    read, event, here, new = read[order], event[order], here[order], new[order]
    firsts = np.arange(len(bounds))
    stays, edit = event != 1, event != 3
    upto = np.searchsorted(read[stays], firsts)
    edits = _edit_lists(np.searchsorted(read[edit], firsts), event[edit], (here - bounds[read])[edit], data[here[edit]], new[edit])
    return new[stays], upto, edits


def channel_markov(
    reads: DataFrame, p_ins: float = 0.01, p_del: float = 0.01, p_sub: float = 0.01, k: int = 3, table: dict | None = None, substitution: dict | None = None, seed: int = 0
) -> DataFrame:
    """Either both tables, (context, event before) -> four chances, or the three rates."""
    if (table is None) != (substitution is None):
        raise ValueError("give both tables or neither")
    if p_ins + p_del + p_sub > 1:
        raise ValueError("rates add up to more than 1")
    table = table or {("", ""): (p_ins, p_del, p_sub, 1 - p_ins - p_del - p_sub)}
    return _mutated(reads, "markov", seed, lambda data, bounds, keys: markov_batch(data, bounds, keys, table, substitution or {}, k))


def burst(reads: DataFrame, window: int, rate: float, seed: int = 0) -> DataFrame:
    """Insertions, deletions and substitutions in equal parts, inside one random window only."""

    def hit(data: np.ndarray, bounds: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        first = _mixed(keys ^ np.uint64(0xA0761D6478BD642F)) % np.maximum(1, np.diff(bounds) - window + 1).astype(np.uint64)
        return indel_batch(data, bounds, keys, rate / 3, rate / 3, rate / 3, window=(first.astype(np.int64), window))

    return _mutated(reads, "burst", seed, hit)


def gc_rate(seq: Column, low: float, high: float) -> Column:
    """An error rate that grows with the distance of GC from a half."""
    n = F.greatest(F.char_length(seq), F.lit(1))
    gc = (F.char_length(seq) - F.char_length(F.translate(seq, "GC", ""))) / n
    return F.lit(low) + (F.lit(high) - F.lit(low)) * 2 * F.abs(gc - 0.5)


def sample_coverage(strand: DataFrame, coverage: float, p_reverse: float = 0.0, seed: int = 0) -> DataFrame:
    """coverage * strands reads on average, drawn with replacement: a Poisson count per strand from its hash uniform.

    A Poisson count per strand is the limit of drawing reads one by one, and
    needs no join. Reads are reverse-complemented with p_reverse; read_order
    is a shuffled order.
    """
    key = [F.col(c) for c in ("payload_id", "strand_idx")]
    top = max(8, math.ceil(coverage + 10 * math.sqrt(coverage)))
    levels, total, term = [], 0.0, math.exp(-coverage)
    for i in range(top + 1):
        total += term
        levels.append(total)
        term *= coverage / (i + 1)
    u = rng.uniform(seed, "coverage", *key)
    n = F.size(F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x <= u))
    drawn = strand.withColumn("copy_no", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))))
    flip = rng.uniform(seed, "flip", *key, F.col("copy_no")) < p_reverse
    return drawn.withColumn("reversed", flip).withColumn("read", F.when(flip, F.reverse(F.translate("dna", "ACGT", "TGCA"))).otherwise(F.col("dna"))).withColumn(
        "read_order", rng.uniform(seed, "order", *key, F.col("copy_no"))
    )


def sample_weighted(strand: DataFrame, coverage: float, weight: Column | None = None, p_reverse: float = 0.0, seed: int = 0) -> DataFrame:
    """Exactly int(coverage * strands) reads, drawn with replacement by weight, a whole number (1 if none is given).

    A draw is a place on the line of all weights. The line is cut into as many
    cells as there are strands, each strand lies in the cells that its weight
    spans, at most three a strand on average, and draws meet strands by cell: a
    heavy strand has many cells, so no key is hot. Adds draw, reversed, read and
    read_order; (payload_id, strand_idx) must be unique.
    """
    key = [F.col(c) for c in ("payload_id", "strand_idx")]
    rows = strand.withColumn("__w", (F.lit(1) if weight is None else F.greatest(F.coalesce(weight, F.lit(0)), F.lit(0))).cast("long"))
    placed = running_total(rows, "__lo", F.col("__w"), *key)
    size = placed.agg(F.count("*").alias("n"), F.sum("__w").alias("total")).first()
    n, total = size["n"], size["total"] or 0
    cell = max(1, total // max(n, 1))
    spans = F.sequence(F.floor(F.col("__lo") / cell), F.floor((F.col("__lo") + F.col("__w") - 1) / cell))
    on_line = placed.filter("__w > 0").withColumn("__cell", F.explode(spans))
    u = rng.uniform(seed, "draw", F.col("id")) + rng.uniform(seed, "more", F.col("id")) / float(2**32)
    draws = strand.sparkSession.range(int(coverage * n) if total else 0).select(F.col("id").alias("draw"), F.least(F.floor(u * total), F.lit(total - 1)).alias("__x")).withColumn("__cell", F.floor(F.col("__x") / cell))
    met = draws.join(on_line, "__cell").filter((F.col("__x") >= F.col("__lo")) & (F.col("__x") < F.col("__lo") + F.col("__w")))
    flip = rng.uniform(seed, "flip", F.col("draw")) < p_reverse
    reads = met.withColumn("reversed", flip).withColumn("read", F.when(flip, F.reverse(F.translate("dna", "ACGT", "TGCA"))).otherwise(F.col("dna")))
    return reads.withColumn("read_order", rng.uniform(seed, "order", F.col("draw"))).drop("__w", "__lo", "__cell", "__x")


def alignment_rates(pairs: DataFrame, a: str = "dna", b: str = "read") -> DataFrame:
    """pairs with n_match, n_sub, n_ins, n_del of difflib's opcodes."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        from difflib import SequenceMatcher

        for xs, ys in batches:
            rows = []
            for x, y in zip(xs.to_pylist(), ys.to_pylist(), strict=True):
                n = {"equal": 0, "replace": 0, "insert": 0, "delete": 0}
                for tag, i1, i2, j1, j2 in SequenceMatcher(None, x or "", y or "", autojunk=False).get_opcodes():
                    n[tag] += max(i2 - i1, j2 - j1)
                rows.append(n)
            yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.int32()) for k in ("equal", "replace", "insert", "delete")], names=["n_match", "n_sub", "n_ins", "n_del"])

    s = F.arrow_udf(run, "struct<n_match:int,n_sub:int,n_ins:int,n_del:int>")(a, b)
    return pairs.withColumn("rates", s).select(*pairs.columns, "rates.*")


def estimate_channel(edits: DataFrame, seq: str = "dna", k: int = 3) -> DataFrame:
    """reads with mutated.edits -> context, event, n, rate: how often each event follows a context."""
    counted = edits.select(F.col(seq).alias("s"), F.col("mutated.edits").alias("e")).filter(F.char_length("s") > 0).mapInArrow(_event_counter(k // 2), "context string, event string, n long")
    n = counted.groupBy("context", "event").agg(F.sum("n").alias("n"))
    total = n.groupBy("context").agg(F.sum("n").alias("total"))
    return n.join(total, "context").select("context", "event", "n", (F.col("n") / F.col("total")).alias("rate"))


def _event_counter(radius: int) -> Callable:
    """Batches of (s, e) -> context, event, n: the events at a batch's bases. Of several edits at a place the first counts."""

    def by_rows(rows: list[dict]) -> Counter:
        """The same a character at a time, where some aren't one byte."""
        found: Counter = Counter()
        for x in rows:
            first: dict = {}
            for e in x["e"] or []:
                first.setdefault(e["pos"], e["mode"])
            found.update((x["s"][max(0, i - radius) : i + radius + 1], first.get(i) or "transmission") for i in range(len(x["s"])))
        return found

    def part(batch: pa.RecordBatch) -> Counter:
        data, bounds, _ = flat(batch.column(0))
        if (data >= 128).any():
            return by_rows(batch.to_pylist())
        lists = batch.column(1)
        edits = lists.flatten()
        row = np.repeat(np.arange(len(batch)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        modes = edits.field("mode").dictionary_encode()
        names = ["transmission", *(m or "transmission" for m in modes.dictionary.to_pylist())]
        pos = pc.fill_null(edits.field("pos"), -1).to_numpy(zero_copy_only=False)
        mode = pc.fill_null(modes.indices, -1).to_numpy(zero_copy_only=False) + 1
        inside = (pos >= 0) & (pos < np.diff(bounds)[row])
        event = np.zeros(len(data), np.int64)
        event[(bounds[row] + pos)[inside][::-1]] = mode[inside][::-1]  # the first at a place is written last
        shift = np.repeat((2 * np.arange(len(batch)) + 1) * radius, np.diff(bounds))
        wide = np.zeros(len(data) + 2 * radius * len(batch), np.uint8)
        at = np.arange(len(data)) + shift
        wide[at] = data
        code = event.astype(np.uint8)
        columns = [wide[at + j] for j in range(-radius, radius + 1)] + [code]
        if len(columns) <= 8:
            key = np.zeros(len(data), np.uint64)
            for c in columns:
                key = key << np.uint64(8) | c
            kinds, n = np.unique(key, return_counts=True)
            texts = [int(x).to_bytes(len(columns), "big") for x in kinds]
        else:
            kinds, n = np.unique(np.ascontiguousarray(np.stack(columns, axis=1)).view(f"V{len(columns)}").reshape(-1), return_counts=True)
            texts = [x.tobytes() for x in kinds]
        found: Counter = Counter()
        for t, m in zip(texts, n.tolist(), strict=True):
            found[t[:-1].replace(b"\0", b"").decode(), names[t[-1]]] += m
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for i in range(0, batch.num_rows, READS):
                found.update(part(batch.slice(i, READS)))
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.string()), pa.array([e for _, e in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["context", "event", "n"])

    return run
