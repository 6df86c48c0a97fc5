"""Codecs between payload tables and strand tables, as plain DataFrame expressions.

payload: payload_id, content BINARY. strand: payload_id, strand_idx, dna.
Every strand carries its place, so no operator relies on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bits, kernels, nt
from ..plans.codec_plan import StrandPlan, index_length
from . import word_ecc

QUADS = "0123"


def ordered_concat(rows: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """The values of each group joined in order of `order`; one row per group."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["v"]), "").alias(out))


# strands of digits: max density (two bits a base) and no homopolymers (one bit a base) -----------

#: Digits of a word by bits per base, and the bases that a strand's digits are read from.
DIGITS = {1: "01", 2: QUADS}


def _words(payload: DataFrame, plan: StrandPlan) -> DataFrame:
    """payload -> payload_id, strand_idx, word: header (bits of a partial last block, else 0), then the left-padded block, as digits."""
    b = plan.bits_per_base
    k = plan.payload_bits // b
    digits = kernels.bytes_to_dna(F.col("content"), QUADS) if b == 2 else kernels.bytes_to_bits(F.col("content"))
    cut = payload.select("payload_id", F.posexplode(bits.pieces(digits, k)).alias("strand_idx", "part"))
    short = F.char_length("part")
    header = F.when(short < k, short * b).otherwise(F.lit(0))
    words = cut.select("payload_id", "strand_idx", F.concat(bits.digits(header, 2**b, plan.header), F.lpad("part", k, "0")).alias("word"))
    return words if not plan.parity_bits else words.withColumn("word", word_ecc.protect(F.col("word"), b, plan.parity_bits // 8))


def _strands(payload: DataFrame, plan: StrandPlan) -> DataFrame:
    """payload -> payload_id, strand_idx, digits: the ordinal before each word."""
    words = _words(payload, plan)
    return words.select("payload_id", "strand_idx", F.concat(bits.digits(F.col("strand_idx"), 2**plan.bits_per_base, plan.barcode), "word").alias("digits"))


#: Letters of digits by place, and digits of letters, of fountain strands.
_FOUNTAIN = {2: np.frombuffer(nt.DENSE.encode(), np.uint8)[None, :], 1: np.frombuffer(b"TGCA", np.uint8).reshape(2, 2)}
_DIGITS = {b: np.full(256, 255, np.uint8) for b in _FOUNTAIN}
for _b, _letters_of in _FOUNTAIN.items():
    for _row in _letters_of:
        _DIGITS[_b][_row] = range(len(_row))


def _contents(read: DataFrame, plan: StrandPlan) -> DataFrame:
    """read (payload_id, digits) -> payload_id, content, n_strands, n_missing, n_failed.

    A word seen twice counts once: one that its parities bear out, else the
    least. content is null if a word is missing before the last, can't be
    corrected, or the bits aren't whole bytes.
    """
    b = plan.bits_per_base
    k, z = plan.payload_bits // b, plan.header
    number = lambda s: F.conv(s, 2**b, 10).cast("long")
    tail = F.substring(F.col("digits"), F.lit(plan.barcode + 1), F.char_length("digits"))
    # One exchange: both groupings below keep to the payload.
    rows = read.repartition("payload_id").select("payload_id", number(F.substring("digits", 1, plan.barcode)).alias("i"), tail.alias("word"))
    if plan.parity_bits:
        rows = rows.withColumn("r", word_ecc.restore(F.col("word"), b, plan.parity_bits // 8)).select("payload_id", "i", F.col("r.word").alias("word"), F.col("r.ok").alias("ok"))
    else:
        rows = rows.withColumn("ok", F.lit(True))
    one = rows.groupBy("payload_id", "i").agg(F.min(F.struct((~F.col("ok")).alias("failed"), F.col("word").alias("word"))).alias("w"))
    used, block = number(F.left(F.col("w.word"), F.lit(z))), F.substring(F.col("w.word"), z + 1, k)
    part = F.when(used > 0, F.right(block, F.least((used / b).cast("int"), F.lit(k)))).otherwise(block)
    one = one.select("payload_id", "i", "w.failed", part.alias("part"))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "part"))), lambda x: x["part"]), "")
    whole = one.groupBy("payload_id").agg(parts.alias("d"), F.count("*").alias("n_strands"), (F.max("i") + 1).alias("wanted"), F.count_if("failed").alias("n_failed"))
    missing = F.col("wanted") - F.col("n_strands")
    content = kernels.dna_to_bytes(F.col("d"), QUADS) if b == 2 else kernels.bits_to_bytes(F.col("d"))
    return whole.select("payload_id", F.when((missing == 0) & (F.col("n_failed") == 0), content).alias("content"), "n_strands", missing.alias("n_missing"), "n_failed")


def encode_max_density(payload: DataFrame, plan: StrandPlan, overhead: float = 5.0, seed: int = 0) -> DataFrame:
    """payload -> strand. Barcode (base-4 ordinal), header, block, and Reed-Solomon parities over header and block if the plan has any.

    With a fountain header in the plan, symbols of those words: n + int(n *
    overhead) for n words. Null and empty contents give no strand.
    """
    if plan.lt_header:
        return word_ecc.fountain_strands(payload, plan, overhead, seed, _FOUNTAIN[2])
    made = _strands(payload, plan)
    return made.select("payload_id", "strand_idx", F.translate("digits", QUADS, nt.DENSE).alias("dna"))


def decode_max_density(strand: DataFrame, plan: StrandPlan) -> DataFrame:
    """strand (payload_id, dna) -> payload_id, content, n_strands, n_missing, n_failed. Strands of another length, or not of ACGT, are dropped."""
    if plan.lt_header:
        return word_ecc.fountain_contents(strand, plan, _DIGITS[2])
    read = strand.filter(nt.valid(F.col("dna")) & (F.char_length("dna") == plan.length))
    return _contents(read.select("payload_id", F.translate("dna", nt.DENSE, QUADS).alias("digits")), plan)


def encode_no_homopolymer(payload: DataFrame, plan: StrandPlan, overhead: float = 2.0, seed: int = 0) -> DataFrame:
    """As encode_max_density with one bit a base; bases alternate between {T, G} and {C, A} by position."""
    if plan.lt_header:
        return word_ecc.fountain_strands(payload, plan, overhead, seed, _FOUNTAIN[1])
    return _strands(payload, plan).select("payload_id", "strand_idx", nt.alternating(F.col("digits")).alias("dna"))


def decode_no_homopolymer(strand: DataFrame, plan: StrandPlan) -> DataFrame:
    """strand (payload_id, dna) -> as decode_max_density."""
    if plan.lt_header:
        return word_ecc.fountain_contents(strand, plan, _DIGITS[1])
    read = strand.filter(nt.valid(F.col("dna")) & (F.char_length("dna") == plan.length))
    return _contents(read.select("payload_id", F.translate("dna", "TCGA", "0011").alias("digits")), plan)


# indexed segments with XOR redundancy ----------------------------------------------------------


def segments(payload: DataFrame, capacity: int, index_bits: int, redundancy: bool = False) -> DataFrame:
    """payload -> payload_id, seg_idx, bits: index then data, the last data right-padded with 0.

    With redundancy every third segment is the XOR of the two data segments
    before it (of the one, if the last pair is short).
    """
    cut = F.arrow_udf(_cutter(capacity - index_bits, index_bits, redundancy), "array<string>")("content")
    return payload.select("payload_id", F.posexplode(cut).alias("seg_idx", "bits")).filter(F.col("bits").isNotNull())


def _cutter(k: int, index_bits: int, redundancy: bool) -> Callable:
    """Contents -> their segments, a list a content; null gives null."""

    def part(column: pa.Array) -> pa.Array:
        data, bounds, valid = kernels.flat(column)
        n = -(-np.diff(bounds) * 8 // k)
        row = np.repeat(np.arange(len(n)), n)
        i = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = (8 * bounds[row] + i * k)[:, None] + np.arange(k)
        flags = np.append(np.unpackbits(data), 0).astype(np.uint8)
        cells = flags[np.where(at < (8 * bounds[row + 1])[:, None], at, len(flags) - 1)]
        if redundancy:
            # Two of data and their parity in the room of three.
            pair = i // 2
            pairs = (n + 1) // 2
            first = (np.cumsum(pairs) - pairs)[row] + pair
            three = np.zeros((int(pairs.sum()), 3, k), np.uint8)
            three[first, i % 2] = cells
            three[:, 2] = three[:, 0] ^ three[:, 1]
            there = np.ones((len(three), 3), bool)
            there[(np.cumsum(pairs) - 1)[(n % 2 == 1)], 1] = False
            cells, size = three[there], n + pairs
            place = (np.arange(len(three)) - np.repeat(np.cumsum(pairs) - pairs, pairs))[:, None] * 3 + np.arange(3)
            place = place[there]
        else:
            size, place = n, i
        index = place[:, None] >> np.arange(index_bits - 1, -1, -1) & 1 if index_bits else np.zeros((len(place), 0), np.int64)
        text = np.concatenate((index.astype(np.uint8), cells), axis=1) + np.uint8(48)
        texts = kernels.column_of(text.reshape(-1), np.arange(len(text) + 1) * (index_bits + k), None, pa.string())
        # The place is the index that the segment carries: a short pair has no second, so a null stands there.
        full = np.full(int(3 * ((n + 1) // 2).sum()) if redundancy else len(place), -1, np.int64)
        ends = np.concatenate(([0], np.cumsum(3 * ((n + 1) // 2) if redundancy else n)))
        full[ends[np.repeat(np.arange(len(n)), size)] + place] = np.arange(len(place))
        taken = texts.take(pa.array(full, pa.int64(), mask=full < 0))
        mask = None if valid is None else pa.array(~valid)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), taken, mask=mask)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            for rows in kernels.sliced(column):
                yield part(rows)

    return run


def repair_segments(found: DataFrame, sizes: DataFrame, index_bits: int, redundancy: bool = False, capacity: int | None = None) -> DataFrame:
    """found (payload_id, bits), sizes (payload_id, n_bits) -> payload_id, bits, n_lost, n_repaired.

    Data segments that are missing are rebuilt from the other two of their
    triple; what stays lost is counted and filled with 0. Without the capacity
    the widest segment found tells it, which reads them twice.
    """
    back = _repaired(found, sizes, index_bits, redundancy, capacity, _LETTERS["01"])
    return back.select("payload_id", F.left(kernels.bytes_to_bits(F.col("packed")), F.col("n_bits").cast("int")).alias("bits"), "n_lost", "n_repaired")


#: The bit of every letter.
_LETTERS = {"01": kernels.bits_of_letters("0", "1"), "ACGT": kernels.bits_of_letters("AC", "GT")}


def _repaired(found: DataFrame, sizes: DataFrame, index_bits: int, redundancy: bool, capacity: int | None, letters: np.ndarray) -> DataFrame:
    """As repair_segments from segments in any letters -> payload_id, n_bits, packed (bits as bytes, the last filled with 0), n_lost, n_repaired.

    Segments cross one exchange packed to an eighth, those of a payload that a
    batch holds as one row, and a payload is put together from those rows.
    """
    keys = found.schema["payload_id"]
    rows = found.select("payload_id", F.col("bits"))
    if capacity is None:
        width = rows.agg(F.max(F.char_length("bits"))).first()[0]
        capacity = width if width is not None else index_bits + 1
    k = capacity - index_bits
    packed = T.StructType([keys, T.StructField("n_bits", T.LongType()), T.StructField("kept", T.BinaryType())])
    kept = rows.filter(F.col("bits").isNotNull()).mapInArrow(_packer(index_bits, k, letters), packed)
    wanted = sizes.filter("n_bits is not null").select("payload_id", F.col("n_bits").cast("long").alias("n_bits"), F.lit(None).cast("binary").alias("kept"))
    made = T.StructType([keys, T.StructField("n_bits", T.LongType()), T.StructField("packed", T.BinaryType()), T.StructField("n_lost", T.LongType()), T.StructField("n_repaired", T.LongType())])
    return kept.unionByName(wanted).repartition("payload_id").sortWithinPartitions("payload_id").mapInArrow(_joiner(k, redundancy, made.names), made)


def _packer(index_bits: int, k: int, letters: np.ndarray) -> Callable:
    """(payload_id, bits) -> payload_id, n_bits null, kept: of each run of a payload's segments their numbers (8 bytes each), then their bits. Shorter ones are filled with 0, longer ones cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            data, bounds, _ = kernels.flat(batch.column(1))
            n = len(batch)
            at = bounds[:-1, None] + np.arange(index_bits + k)
            flags = np.append(letters[data], 0).astype(np.uint8)
            cells = flags[np.where(at < bounds[1:, None], at, len(flags) - 1)]
            number = np.zeros(n, np.int64)
            for j in range(index_bits):
                number = number * 2 + cells[:, j]
            record = np.concatenate((number.astype("<i8").view(np.uint8).reshape(n, 8), np.packbits(cells[:, index_bits:], axis=1)), axis=1)
            new = np.ones(n, bool)
            new[1:] = np.array(pc.fill_null(pc.not_equal(ids.slice(1), ids.slice(0, max(0, n - 1))), True), bool)
            starts = np.flatnonzero(new)
            blobs = kernels.column_of(record.reshape(-1), np.append(starts, n) * record.shape[1], None, pa.binary())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(starts)), pa.nulls(len(starts), pa.int64()), blobs], names=["payload_id", "n_bits", "kept"])

    return run


def _joiner(k: int, redundancy: bool, names: list[str]) -> Callable:
    """Rows in order of their payload (payload_id, n_bits or null, kept or null) -> one row for each payload that has a size."""
    wide = 8 + (k + 7) // 8

    def one(n_bits: int, blobs: list[bytes]) -> tuple[bytes, int, int]:
        have = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, wide)
        number, own = have[:, :8].copy().view("<i8").reshape(-1), have[:, 8:]
        n = -(-n_bits // k)
        total = (n + 1) // 2 * 3 if redundancy else n
        known, cells = np.zeros(total, bool), np.zeros((total, wide - 8), np.uint8)
        inside = np.flatnonzero(number < total)
        # Of two with one number the greater text counts: it is written last.
        if len(np.unique(number[inside])) < len(inside):
            inside = np.array(sorted(inside.tolist(), key=lambda i: own[i].tobytes()), np.int64)
        known[number[inside]] = True
        cells[number[inside]] = own[inside]
        repaired = 0
        if redundancy:
            there, three = known.reshape(-1, 3), cells.reshape(-1, 3, wide - 8)
            if n % 2:  # the second of the last pair is all 0 and isn't sent
                there[-1, 1], three[-1, 1] = True, 0
            for a, b in ((0, 1), (1, 0)):
                lost = ~there[:, a] & there[:, b] & there[:, 2]
                three[lost, a] = three[lost, b] ^ three[lost, 2]
                repaired += int(lost.sum())
                there[lost, a] = True
            known, cells = there[:, :2].reshape(-1)[:n], three[:, :2].reshape(-1, wide - 8)[:n]
        flags = np.unpackbits(cells, axis=1)[:, :k].reshape(-1)[:n_bits]
        return np.packbits(flags).tobytes(), int(n - known.sum()), repaired

    def done(table: pa.Table) -> pa.RecordBatch:
        ids, out = [], []
        rows = zip(*[table.column(c).to_pylist() for c in range(3)], strict=True)
        for key, group in groupby(rows, key=lambda x: x[0]):
            group = list(group)
            n_bits = next((x[1] for x in group if x[1] is not None), None)
            if n_bits is not None and key is not None:
                ids.append(key)
                out.append((n_bits, *one(n_bits, [x[2] for x in group if x[2] is not None])))
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(ids, table.column(0).type), *[pa.array([o[j] for o in out], t) for j, t in enumerate(kinds)]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            ids = table.column(0).combine_chunks()
            # The last payload may go on in the next batch.
            same = np.array(pc.fill_null(pc.equal(ids, ids[len(ids) - 1]), False), bool) if len(ids) else np.zeros(0, bool)
            last = len(same) - int(same.sum())
            if last:
                yield done(table.slice(0, last))
            rest = table.slice(last)
        if rest is not None and rest.num_rows:
            yield done(rest)

    return run


# church ----------------------------------------------------------------------------------------


def church_bases(b: Column, run: int = 4) -> Column:
    """A for 0 and G for 1; after `run` equal bases the other base of the bit, C or T."""
    zero = F.regexp_replace(b, F.lit("0" * (run + 1)), F.lit("A" * run + "C"))
    one = F.regexp_replace(zero, F.lit("1" * (run + 1)), F.lit("G" * run + "T"))
    return F.translate(one, "01", "AG")


def church_bits(dna: Column) -> Column:
    return F.translate(dna, "ACGT", "0011")


def encode_church(payload: DataFrame, capacity: int = 200, index_bits: int = 16, run: int = 4, redundancy: bool = False) -> DataFrame:
    seg = segments(payload, capacity, index_bits, redundancy)
    return seg.select("payload_id", F.col("seg_idx").alias("strand_idx"), church_bases(F.col("bits"), run).alias("dna"))


def decode_church(strand: DataFrame, sizes: DataFrame, index_bits: int = 16, redundancy: bool = False, capacity: int | None = None) -> DataFrame:
    """strand (payload_id, dna), sizes (payload_id, n_bits) -> payload_id, content, n_lost, n_repaired. content is null unless the bits are whole bytes."""
    found = strand.filter(nt.valid(F.col("dna"))).select("payload_id", F.col("dna").alias("bits"))
    back = _repaired(found, sizes, index_bits, redundancy, capacity, _LETTERS["ACGT"])
    return back.select("payload_id", F.when(F.col("n_bits") % 8 == 0, F.col("packed")).alias("content"), "n_lost", "n_repaired")


def plan_segments(total_bits: int, capacity: int) -> tuple[int, int]:
    return index_length(total_bits, capacity)


# goldman ---------------------------------------------------------------------------------------


def _trits_of(b: int) -> str:
    n, out = (b if b <= 235 else b + 472), ""
    while n:
        n, out = n // 3, "012"[n % 3] + out
    return out.rjust(5, "0")


_TRITS = [_trits_of(b) for b in range(256)]


def _trits(data: np.ndarray, bounds: np.ndarray, valid: np.ndarray | None) -> tuple:
    table = np.frombuffer("".join(t.ljust(6) for t in _TRITS).encode(), np.uint8).reshape(256, 6)
    made = table[data]
    upto = np.concatenate(([0], np.cumsum(5 + (data > 235))))
    return made[made != ord(" ")], upto[bounds], valid


def _rotated(data: np.ndarray, bounds: np.ndarray, valid: np.ndarray | None) -> tuple:
    upto = np.concatenate(([0], np.cumsum(data.astype(np.int64) - 47)))
    place = upto[1:] - np.repeat(upto[bounds[:-1]], np.diff(bounds))
    return np.frombuffer(b"ACGT", np.uint8)[place % 4], bounds, valid


def _unrotated(data: np.ndarray, bounds: np.ndarray, valid: np.ndarray | None) -> tuple:
    code = np.full(256, -1, np.int64)
    code[list(b"ACGT")] = range(4)
    place, size = code[data], np.diff(bounds)
    before = np.concatenate(([0], place[:-1]))[: len(place)]
    before[bounds[:-1][size > 0]] = 0
    trit = (place - before - 1) % 4
    good = size > 0
    good[np.searchsorted(bounds, np.flatnonzero(trit == 3), "right") - 1] = False
    if valid is not None:
        good &= valid
    return (trit[np.repeat(good, size)] + 48).astype(np.uint8), np.concatenate(([0], np.cumsum(np.where(good, size, 0)))), good


def _trits_read(data: np.ndarray, bounds: np.ndarray, valid: np.ndarray | None) -> tuple:
    """All rows go on by a byte at a time: five trits, or six if those are above 22201."""
    trit = np.append(data.astype(np.int64) - 48, [0] * 6)
    five = np.zeros(len(data) + 1, np.int64)
    for k in range(5):
        five = five * 3 + trit[k : k + len(five)]
    at, live, trail = bounds[:-1].copy(), np.arange(len(bounds) - 1), []
    while len(live):
        here = at[live]
        wide = 5 + (five[here] > 235)
        live, here, wide = (x[here + wide <= bounds[live + 1]] for x in (live, here, wide))
        trail.append((live, np.where(wide == 5, five[here], five[here] * 3 + trit[here + 5] - 472)))
        at[live] = here + wide
    row, value = (np.concatenate([t[j] for t in trail] or [np.zeros(0, np.int64)]) for j in range(2))
    order = np.argsort(row, kind="stable")
    # Six trits of 2 stand for no byte.
    value = np.where(value > 255, 16, value)[order].astype(np.uint8)
    return value, np.searchsorted(row[order], np.arange(len(bounds))), valid


def byte_trits(content: Column) -> Column:
    """Bytes up to 235 as five trits, others as the six trits of the byte plus 472."""
    return kernels.mapped("byte_trits", "string", _trits)(content)


def rotate(trits: Column) -> Column:
    """base_i = sum of (trit + 1) up to i, modulo 4, in ACGT: never the base before."""
    return kernels.mapped("rotate", "string", _rotated)(trits)


def unrotate(dna: Column) -> Column:
    """Trits of a strand; null where a base repeats the one before, and of an empty strand."""
    return kernels.mapped("unrotate", "string", _unrotated)(dna)


def trit_bytes(trits: Column) -> Column:
    """Inverse of byte_trits: five trits, or six if the first five are above 22201; what is left over is dropped."""
    return kernels.mapped("trit_bytes", "binary", _trits_read)(trits)


def encode_goldman(payload: DataFrame, quarter: int = 25, index_trits: int = 10) -> DataFrame:
    """Fourfold overlapping windows of 4 * quarter trits, one every quarter, with their index before them.

    Windows start at each quarter until the text is covered; the last is
    right-padded with 0. Contents shorter than a window give one strand.
    """
    trits = payload.select("payload_id", byte_trits(F.col("content")).alias("t")).filter(F.char_length("t") > 0)
    # Windows are made of their quarters: a substring a window would carry the whole text with each.
    windows = bits.let(bits.pieces(F.col("t"), quarter), lambda p: F.transform(F.sequence(F.lit(1), F.greatest(F.size(p) - 3, F.lit(1))), lambda i: F.array_join(F.slice(p, i, 4), "")))
    cut = trits.select("payload_id", F.posexplode(windows).alias("strand_idx", "w"))
    window = F.rpad("w", 4 * quarter, "0")
    return cut.select("payload_id", "strand_idx", rotate(F.concat(bits.digits(F.col("strand_idx"), 3, index_trits), window)).alias("dna"))


def decode_goldman(strand: DataFrame, sizes: DataFrame, quarter: int = 25, index_trits: int = 10) -> DataFrame:
    """strand (payload_id, dna), sizes (payload_id, n_trits) -> payload_id, content, n_quarters_lost.

    Each quarter has up to four copies; the most frequent text wins, ties the
    least. Strands with a repeated base are dropped.
    """
    read = strand.filter(nt.valid(F.col("dna")) & (F.char_length("dna") == index_trits + 4 * quarter)).select("payload_id", unrotate(F.col("dna")).alias("t")).filter(F.col("t").isNotNull())
    read = read.select("payload_id", F.conv(F.left("t", F.lit(index_trits)), 3, 10).cast("long").alias("i"), F.substring("t", index_trits + 1, 4 * quarter).alias("w"))
    votes = read.select("payload_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.struct((F.col("i") + j).alias("q"), F.substring(F.col("w"), j * quarter + 1, F.lit(quarter)).alias("part")))).alias("x")).groupBy("payload_id", "x.q", "x.part").agg(F.count("*").alias("n"))
    best = votes.groupBy("payload_id", "q").agg(F.min(F.struct((-F.col("n")).alias("n"), "part")).alias("b")).select("payload_id", "q", F.col("b.part").alias("part"))
    parts = F.array_sort(F.collect_list(F.struct("q", "part")))
    whole = best.groupBy("payload_id").agg(F.array_join(F.transform(parts, lambda x: x["part"]), "").alias("t"), F.collect_set("q").alias("qs"))
    lost = F.ceil(F.col("n_trits") / quarter) - F.size(F.filter("qs", lambda q: q < F.ceil(F.col("n_trits") / quarter)))
    return whole.join(sizes, "payload_id").select("payload_id", F.when(lost == 0, trit_bytes(F.left("t", F.col("n_trits").cast("int")))).alias("content"), lost.alias("n_quarters_lost"))
