"""Guess-and-check codes for insertions and deletions: Reed-Solomon symbols of four bases and a codebook check symbol."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ecc.reed_solomon import code
from ..functions.kernels import column_of, flat

#: Bits, symbol bits, free parities; bases of a check codeword. Fixed values.
K_BITS, SYMBOL, FREE, CHECK_NT = 168, 8, 2, 12
SYMBOLS = K_BITS // SYMBOL
PER = SYMBOL // 2
LENGTH = PER * (SYMBOLS + FREE) + CHECK_NT
#: Bases of 00, 01, 10, 11. Fixed values.
ORDER = "ATCG"
#: Shifts of the block lengths that decoding tries.
LIMIT = 5


def edit_distances(word: str, book: np.ndarray, free_start: bool = False) -> np.ndarray:
    """Edit distances of a word to every row of a codebook of letters; with free_start any beginning of the word is free."""
    n, width = len(word), book.shape[1]
    row = np.tile(np.arange(width + 1), (len(book), 1))
    for i in range(1, n + 1):
        new = np.empty_like(row)
        new[:, 0] = 0 if free_start else i
        cost = (book != ord(word[i - 1])).astype(int)
        for j in range(1, width + 1):
            new[:, j] = np.minimum(np.minimum(new[:, j - 1], row[:, j]) + 1, row[:, j - 1] + cost[:, j - 1])
        row = new
    return row[:, -1]


@functools.cache
def codebook(size: int = 256, width: int = CHECK_NT, apart: int = 4, seed: int = 7) -> tuple[str, ...]:
    """Words found greedily among seeded random ones, at least `apart` edits from each other, without runs of four."""
    g = np.random.Generator(np.random.PCG64(seed))
    found = np.zeros((0, width), np.uint8)
    while len(found) < size:
        words = g.integers(0, 4, (size, width)).astype(np.uint8)
        same = words[:, 1:] == words[:, :-1]
        words = words[~(same[:, 2:] & same[:, 1:-1] & same[:, :-2]).any(axis=1)]
        words = words[(_distances(words, found) >= apart).all(axis=1)]
        far, kept = _distances(words, words) >= apart, np.zeros(len(words), bool)
        for k in range(len(words)):
            kept[k] = far[k, kept].all()
        found = np.concatenate((found, words[kept]))
    return tuple("".join(ORDER[b] for b in w) for w in found[:size])


def _distances(words: np.ndarray, book: np.ndarray, free_start: bool = False) -> np.ndarray:
    """edit_distances() of rows of bases to rows of at most 16 bases, as a matrix: a column of the table at a time, by bits for all pairs."""
    bits, top = 1 << np.arange(book.shape[1]), np.uint16(book.shape[1] - 1)
    masks = np.stack([((book == b) * bits).sum(axis=1) for b in range(4)]).astype(np.uint16)
    plus, minus = np.full((len(words), len(book)), 0xFFFF, np.uint16), np.zeros((len(words), len(book)), np.uint16)
    far = np.full(plus.shape, book.shape[1], np.int16)
    for k in range(words.shape[1]):
        same = masks[words[:, k]]
        level, down = (((same & plus) + plus) ^ plus) | same, same | minus
        up, less = minus | ~(level | plus), plus & level
        far += ((up >> top) & 1).astype(np.int16) - ((less >> top) & 1).astype(np.int16)
        up, less = up << 1 | np.uint16(not free_start), less << 1
        plus, minus = less | ~(down | up), up & down
    return far


def _nt(symbols: np.ndarray) -> str:
    return "".join(ORDER[(s >> shift) & 3] for s in symbols for shift in range(SYMBOL - 2, -1, -2))


def _symbols(dna: str) -> np.ndarray:
    quads = [ORDER.index(b) for b in dna]
    return np.array([functools.reduce(lambda a, b: a * 4 + b, quads[i : i + PER], 0) for i in range(0, len(quads), PER)], np.int64)


def encode_rows(data: np.ndarray) -> np.ndarray:
    """Rows of 21 bytes -> rows of 104 letters."""
    word = code(FREE + 1).encode(data)
    letters = np.frombuffer(ORDER.encode(), np.uint8)
    bases = letters[(word[:, :-1, None] >> np.arange(SYMBOL - 2, -1, -2)) & 3].reshape(len(word), -1)
    checks = np.frombuffer("".join(codebook()).encode(), np.uint8).reshape(-1, CHECK_NT)
    return np.concatenate((bases, checks[word[:, -1]]), axis=1)


def encode_block(data: bytes) -> str:
    """21 bytes (padded with zero bytes) -> a strand of 104 bases."""
    return encode_rows(np.frombuffer(data.ljust(SYMBOLS, b"\0"), np.uint8)[None, :])[0].tobytes().decode()


@functools.cache
def patterns(shift: int, depth: int) -> tuple[dict[int, int], ...]:
    """Blocks that gained or lost bases, total `shift`; fewer blocks first.

    Pairs have parts of the shift's sign; depth adds those of opposite signs.
    """
    blocks, sign = SYMBOLS + FREE, 1 if shift > 0 else -1
    found = [{}] if shift == 0 else [{i: shift} for i in range(blocks)]
    firsts = [sign * a for a in range(1, abs(shift))]
    if depth:
        firsts += [a for a in (-2, -1, 1, 2) if a not in firsts and shift - a and abs(shift - a) <= 2]
    found += [{i: a, j: shift - a} for i, j in combinations(range(blocks), 2) for a in firsts]
    return tuple(found)


@functools.cache
def _weighted() -> np.ndarray:
    """What a symbol in a block adds to the three syndromes, a byte each: (blocks, 256)."""
    f, n = code(FREE + 1).field, SYMBOLS + FREE
    x = _locators()[:, None]
    v = np.arange(256)[None, :]
    return (v | f.mul(x, v) << 8 | f.mul(f.mul(x, x), v) << 16).astype(np.uint32).reshape(n, 256)


@functools.cache
def _locators() -> np.ndarray:
    f, n = code(FREE + 1).field, SYMBOLS + FREE
    return np.array([int(f.power(n - i)) for i in range(n)], np.int64)


@functools.cache
def _pairs() -> tuple[np.ndarray, ...]:
    """All pairs of blocks i < j, and for each, times which s0 and s1 must add up to s2: (pairs * 256) products of a pair's constants."""
    f, x = code(FREE + 1).field, _locators()
    i, j = np.array(list(combinations(range(len(x)), 2))).T
    v = np.arange(256)[None, :]
    return i, j, f.mul(f.mul(x[i], x[j])[:, None], v).astype(np.uint8).reshape(-1), f.mul((x[i] ^ x[j])[:, None], v).astype(np.uint8).reshape(-1)


@functools.cache
def _firsts(shift: int) -> tuple[int, ...]:
    """What the first block of a pair may gain or lose, in the order of patterns()."""
    found = patterns(shift, 1 if abs(shift) <= 1 else 0)
    return tuple(dict.fromkeys(next(iter(p.values())) for p in found if len(p) == 2))


@functools.cache
def _inverses() -> np.ndarray:
    f = code(FREE + 1).field
    return np.array([0, *(int(f.inv(x)) for x in range(1, 256))], np.int64)


@functools.cache
def _book() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Check words as bases, as numbers in order, and the places of those."""
    bases = _CODES[np.frombuffer("".join(codebook()).encode(), np.uint8)].reshape(-1, CHECK_NT)
    numbers = _number(bases)
    order = np.argsort(numbers)
    return bases, numbers[order], order


def _number(bases: np.ndarray) -> np.ndarray:
    return bases.astype(np.int64) @ (4 ** np.arange(bases.shape[1] - 1, -1, -1))


def _changes(bases: np.ndarray, size: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Edit distances of the first size bases of each row to the four of a symbol."""
    row = [np.full(len(bases), j, np.int8) for j in range(PER + 1)]
    wanted = [(symbol >> shift & 3).astype(np.uint8) for shift in range(SYMBOL - 2, -1, -2)]
    out = row[PER].copy()
    for i in range(int(size.max(initial=0))):
        base = bases[:, i]
        new = [row[0] + np.int8(1)]
        for j in range(1, PER + 1):
            new.append(np.minimum(np.minimum(new[j - 1], row[j]) + np.int8(1), row[j - 1] + (base != wanted[j - 1])))
        row = new
        np.copyto(out, row[PER], where=size == i + 1)
    return out.astype(np.int64)


#: Cost of no guess.
_NONE = 1 << 20


def _guess(bases: np.ndarray, check: np.ndarray, shift: int, others: dict[int, set[bytes]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For rows of bases with a total shift: edits, and symbols, of the guess that the codeword bears out with the fewest edits in its erased blocks; all patterns at once.

    Ties go to the first of patterns(); others, if given, gets the symbols that
    rows have by further guesses of as few edits. Syndromes of a pattern are
    XORs of running ones: before its first block, between them, and after.
    """
    f, x, n, blocks = code(FREE + 1).field, _locators(), len(bases), SYMBOLS + FREE
    at = PER * np.arange(blocks)
    value = np.zeros((n, bases.shape[1] - PER + 1), np.uint8)
    for k in range(PER):
        value = value << 2 | bases[:, k : k + value.shape[1]]

    @functools.cache
    def upto(off: int) -> np.ndarray:
        """Syndromes of the blocks before each, read so many bases later."""
        out = np.zeros((n, blocks + 1), np.uint32)
        np.bitwise_xor.accumulate(_weighted()[np.arange(blocks), value[:, np.maximum(at + off, 0)]], axis=1, out=out[:, 1:])
        return out

    whole = upto(shift)[:, -1:] ^ (check.astype(np.uint32) * np.uint32(0x10101))[:, None]
    best, fixed = np.full(n, _NONE), np.zeros((n, SYMBOLS), np.uint8)

    def take(row: np.ndarray, i: np.ndarray, j: np.ndarray, a: np.ndarray, first: np.ndarray, second: np.ndarray, order: np.ndarray) -> None:
        """Guesses (block i, that gained a bases, becomes first; j second; one block only where they are the same): the best of each row."""
        cells = np.minimum((at[i] + np.arange(2 * PER)[:, None]).T, bases.shape[1] - 1)
        cost = _changes(bases[row[:, None], cells], PER + a, first)
        two = np.flatnonzero(i != j)
        cells = np.minimum((at[j[two]] + a[two] + np.arange(2 * PER)[:, None]).T, bases.shape[1] - 1)
        cost[two] += _changes(bases[row[two, None], cells], PER + shift - a[two], second[two])
        ranked = np.lexsort((order, cost, row))
        least = np.append(True, row[ranked][1:] != row[ranked][:-1]) if len(ranked) else np.zeros(0, bool)
        k = np.arange(blocks)

        def words(at_: np.ndarray) -> np.ndarray:
            r, b, c = row[at_], i[at_, None], j[at_, None]
            word = value[r[:, None], at + np.where(k <= b, 0, np.where(k < c, a[at_, None], shift))]
            word[np.arange(len(r)), c[:, 0]] = second[at_]
            word[np.arange(len(r)), b[:, 0]] = first[at_]
            return word[:, :SYMBOLS]

        better = ranked[least]
        better = better[cost[better] < best[row[better]]]
        best[row[better]] = cost[better]
        fixed[row[better]] = words(better)
        if others is not None:
            for r in row[better].tolist():
                others.pop(r, None)
            tied = np.setdiff1d(ranked[cost[ranked] == best[row[ranked]]], better)
            found = words(tied)
            for t in np.flatnonzero((found != fixed[row[tied]]).any(axis=1)).tolist():
                others.setdefault(int(row[tied[t]]), set()).add(found[t].tobytes())

    if shift:
        s = upto(0)[:, :-1] ^ whole ^ upto(shift)[:, 1:]
        s0, s1 = (s & 255).astype(np.int64), (s >> 8 & 255).astype(np.int64)
        # Syndromes of erasures alone follow the recurrence of their locators.
        row, i = np.nonzero((f.mul(s0, x) == s1) & (f.mul(s1, x) == (s >> 16)))
        take(row, i, i, np.full(len(i), shift), s0[row, i], s0[row, i], i)
    # A pair has as many edits at least as bases come and gone.
    firsts = _firsts(shift)
    left = np.flatnonzero(best + (others is not None) > min(abs(a) + abs(shift - a) for a in firsts)) if firsts else np.zeros(0, np.int64)
    if len(left):
        i, j, by_s0, by_s1 = _pairs()
        base = (np.arange(len(i)) << 8)[None, :]
        found = []
        for order, a in enumerate(firsts):
            s = ((upto(0)[left, :-1] ^ upto(a)[left, 1:] ^ whole[left])[:, i]) ^ ((upto(a)[left, :-1] ^ upto(shift)[left, 1:])[:, j])
            good = (by_s0[base | (s & 255)] ^ by_s1[base | (s >> 8 & 255)]) == (s >> 16)
            row, p = np.nonzero(good)
            hit = s[row, p].astype(np.int64)
            found.append((left[row], p, np.full(len(p), a), hit, p * len(firsts) + order))
        row, p, a, s, order = (np.concatenate(v) for v in zip(*found, strict=True))
        s0, s1, i, j = s & 255, s >> 8 & 255, i[p], j[p]
        first = f.mul(s1 ^ f.mul(x[j], s0), _inverses()[x[i] ^ x[j]])
        take(row, i, j, a, first, s0 ^ first, order)
    return best, fixed


#: Bases as numbers, 255 for others.
_CODES = np.full(256, 255, np.uint8)
_CODES[list(ORDER.encode())] = range(4)


def decode_rows(data: np.ndarray, bounds: np.ndarray, others: dict[int, set[bytes]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Payloads of strands, and whether they were decoded: guess where bases came or went, erase those blocks, check against the codebook symbol.

    Of the guesses that check, the one of the fewest edits counts, ties the
    first. Two codewords can be one edit from the same strand: others, if
    given, gets the payloads that strands have by further guesses of as few edits.
    """
    head, most = PER * (SYMBOLS + FREE), LENGTH + LIMIT - 1
    size = np.diff(bounds)
    fine = abs(size - LENGTH) < LIMIT
    fine[np.searchsorted(bounds, np.flatnonzero(_CODES[data] == 255), "right") - 1] = False
    out, ok = np.zeros((len(size), SYMBOLS), np.uint8), np.zeros(len(size), bool)
    rows = np.flatnonzero(fine)
    if not len(rows):
        return out, ok
    shift = size[rows] - LENGTH
    cells = bounds[rows, None] + np.arange(most + 2 * PER)
    bases = np.where(cells < bounds[rows + 1, None], _CODES[data[np.minimum(cells, len(data) - 1)]], 0).astype(np.uint8)
    ends = lambda k, at: bases[at[:, None], (size[rows[at], None] - k) + np.arange(k)]
    book, numbers, order = _book()
    last = _number(ends(CHECK_NT, np.arange(len(rows))))
    place = np.minimum(np.searchsorted(numbers, last), len(numbers) - 1)
    check, tail = order[place], np.zeros(len(rows), np.int64)
    other = np.flatnonzero(numbers[place] != last)
    if len(other):
        far = _distances(ends(CHECK_NT + LIMIT - 1, other), book, free_start=True)
        check[other], tail[other] = far.argmin(axis=1), far.min(axis=1)
    best, x, f = np.full(len(rows), _NONE), _locators(), code(FREE + 1).field
    blocks = np.zeros((len(rows), SYMBOLS), np.uint8)
    open_ = np.ones(len(rows), bool)
    # What the check word may have gained or lost itself.
    for own in sorted(range(-CHECK_NT, CHECK_NT + 1), key=abs):
        rest = shift - own
        now = open_ & (tail >= abs(own)) & (abs(rest) < LIMIT)
        if not (open_ & (tail >= abs(own))).any():
            break
        for r in np.unique(rest[now]).tolist():
            at = np.flatnonzero(now & (rest == r))
            # Bases after the blocks don't count.
            part = bases[at, : head + r + PER].copy()
            part[:, head + r :] = 0
            cost, found = np.full(len(at), _NONE), np.zeros((len(at), SYMBOLS), np.uint8)
            more_of: dict[int, set[bytes]] | None = None if others is None else {}
            if r == 0:
                symbols = (part[:, :head].reshape(len(at), -1, PER).astype(np.int64) << np.arange(SYMBOL - 2, -1, -2)).sum(axis=2)
                s = np.bitwise_xor.reduce(_weighted()[np.arange(SYMBOLS + FREE), symbols], axis=1).astype(np.int64) ^ check[at] * 0x10101
                s0, s1, s2 = s & 255, s >> 8 & 255, s >> 16
                one = (f.mul(s0[:, None], x) == s1[:, None]) & (f.mul(s1[:, None], x) == s2[:, None]) & (s0 != 0)[:, None]
                k = np.flatnonzero(one.any(axis=1))
                symbols[k, one[k].argmax(axis=1)] ^= s0[k]
                cost[k] = 1
                cost[s == 0] = 0
                found[:] = symbols[:, :SYMBOLS]
            more = np.flatnonzero(cost == _NONE)
            if len(more):
                cost[more], found[more] = _guess(part[more], check[at[more]], r, more_of)
            cost = np.where(cost < _NONE, cost + abs(own), _NONE)
            better = cost < best[at]
            if others is not None:
                also = {int(more[t]): words for t, words in more_of.items()} if len(more) else {}
                for t in np.flatnonzero(better).tolist():
                    others.pop(int(rows[at[t]]), None)
                for t in np.flatnonzero((cost < _NONE) & (cost == best[at]) & (found != blocks[at]).any(axis=1)).tolist():
                    also.setdefault(t, set()).add(found[t].tobytes())
                for t, words in also.items():
                    words.discard(blocks[at[t]].tobytes() if not better[t] else b"")
                    if words and (better[t] or cost[t] == best[at[t]]):
                        others.setdefault(int(rows[at[t]]), set()).update(words)
            best[at[better]], blocks[at[better]] = cost[better], found[better]
        # Guesses of the next pass have an edit more; where ties count, those of as few are tried too.
        open_ &= ~((tail >= abs(own)) & (best <= abs(own) + (others is None)))
    good = best < _NONE
    out[rows[good]], ok[rows[good]] = blocks[good], True
    return out, ok


def decode_block(dna: str) -> tuple[bytes, bool]:
    """decode_rows() of one strand."""
    data = np.frombuffer(dna.encode("latin-1", "replace"), np.uint8)
    out, ok = decode_rows(data, np.array([0, len(data)]))
    return out[0].tobytes(), bool(ok[0])


#: Strands that one pass of decoding works on: its arrays hold a number for each and every pattern.
ROWS = 1000


def encode(payload: DataFrame, *keep: str) -> DataFrame:
    """payload (payload_id, content) -> payload_id, strand_idx, dna, after columns to keep: the payload's, or block, the bytes that a strand holds (padded with zero bytes).

    Strands carry no index of their own: keep strand_idx.
    """
    n = F.octet_length("content")
    cut = F.when(n > 0, F.transform(F.sequence(F.lit(1), n, F.lit(SYMBOLS)), lambda i: F.rpad(F.substring("content", i, F.lit(SYMBOLS)), F.lit(SYMBOLS), F.lit(b"\0"))))
    rows = payload.select("payload_id", F.posexplode(cut).alias("strand_idx", "block"), *[k for k in keep if k != "block"])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            made = encode_rows(flat(column)[0].reshape(-1, SYMBOLS))
            yield column_of(made.reshape(-1), np.arange(len(made) + 1) * LENGTH, None, pa.string())

    return rows.select("payload_id", "strand_idx", *keep, F.arrow_udf(run, "string")("block").alias("dna"))


def decode(strand: DataFrame, *keep: str, ties: bool = False) -> DataFrame:
    """payload_id, strand_idx, dna -> payload_id, strand_idx, columns to keep, block, ok; with ties others, the blocks of further guesses of as few edits, one after another (null: none)."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            parts, others = [], {}
            for i in range(0, max(1, len(column)), ROWS):
                tied = {} if ties else None
                parts.append(decode_rows(*flat(column.slice(i, ROWS))[:2], tied))
                others |= {i + r: b"".join(sorted(words)) for r, words in (tied or {}).items()}
            blocks, ok = (np.concatenate(p) for p in zip(*parts, strict=True))
            made = {"block": column_of(blocks.reshape(-1), np.arange(len(blocks) + 1) * SYMBOLS, None, pa.binary()), "ok": pa.array(ok, pa.bool_())}
            if ties:
                made["others"] = pa.array([others.get(r) for r in range(len(column))], pa.binary())
            yield pa.StructArray.from_arrays(list(made.values()), names=list(made))

    kind = "struct<block:binary,ok:boolean" + (",others:binary>" if ties else ">")
    return strand.withColumn("d", F.arrow_udf(run, kind)("dna")).select("payload_id", "strand_idx", *keep, "d.*")


#: Bytes of a payload's seal; choices between guesses that are followed up for one payload.
SEAL, CHOICES = 4, 1 << 16


def sealed(payload: DataFrame) -> DataFrame:
    """payload with its content's CRC-32 after the content: a strand's own check can't tell two codewords that are one edit from it."""
    return payload.withColumn("content", F.concat("content", F.unhex(F.lpad(F.hex(F.crc32("content")), 2 * SEAL, "0"))))


def opened(decoded: DataFrame, size: str) -> DataFrame:
    """decode(..., size, ties=True) of sealed payloads of so many bytes without the seal -> payload_id, content, ok. Where guesses tie, those count that the seal bears out; ok is whether it does."""
    choice = F.when(F.col("others").isNotNull(), F.struct("strand_idx", "others"))
    whole = decoded.groupBy("payload_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("strand_idx", F.hex("block").alias("h")))), lambda x: x["h"]), "").alias("h"),
        F.collect_list(choice).alias("tied"), F.min("ok").alias("ok"), F.max(size).cast("int").alias("n"),
    )
    tied = F.size("tied") > 0
    settled = _settle(F.when(tied, F.unhex("h")), F.when(tied, F.col("tied")), "n")
    whole = whole.select("payload_id", "ok", "n", F.coalesce(settled, F.unhex(F.left("h", 2 * (F.col("n") + SEAL)))).alias("c"))
    content = F.substring(F.col("c"), F.lit(1), F.col("n"))
    seal = F.conv(F.hex(F.substring(F.col("c"), F.col("n") + 1, F.lit(SEAL))), 16, 10).cast("long")
    return whole.select("payload_id", content.alias("content"), (F.col("ok") & F.coalesce(F.crc32(content) == seal, F.lit(False))).alias("ok"))


def _settle(blocks: Column, tied: Column, n: str) -> Column:
    """A payload's n bytes and seal, of all its blocks and the others that strands may hold: null where no choice, or more than one, is borne out by the seal, or there are more than CHOICES."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for data, choices, sizes in batches:
            yield pa.array([None if d is None else chosen(d, c, m) for d, c, m in zip(data.to_pylist(), choices.to_pylist(), sizes.to_pylist(), strict=True)], pa.binary())

    return F.arrow_udf(run, "binary")(blocks, tied, n)


def chosen(data: bytes, tied: list[dict], n: int) -> bytes | None:
    """The one of the choices (strand_idx, others: blocks) whose first n bytes agree with the seal after them.

    A CRC is affine: what each replaced block changes adds up.
    """
    open_ = lambda d: zlib.crc32(d[:n]) ^ int.from_bytes(d[n : n + SEAL])
    put = lambda d, i, block: d[: i * SYMBOLS] + block + d[(i + 1) * SYMBOLS :]
    left = open_(data)
    reached: list[tuple[int, tuple]] = [(left, ())]
    for t in tied:
        i, more = t["strand_idx"], t["others"]
        blocks = [more[k : k + SYMBOLS] for k in range(0, len(more), SYMBOLS)]
        if len(reached) * (len(blocks) + 1) > CHOICES:
            return None
        steps = [(0, ()), *((open_(put(data, i, b)) ^ left, ((i, b),)) for b in blocks)]
        reached = [(a ^ b, p + q) for a, p in reached for b, q in steps]
    right = {functools.reduce(lambda d, p: put(d, *p), picks, data)[: n + SEAL] for a, picks in reached if a == 0}
    return right.pop() if len(right) == 1 else None


def encode_repeated(data: bytes, times: int = 3) -> str:
    """The variant whose parity bits are repeated instead of coded: each parity base `times` times."""
    word = code(FREE).encode(np.frombuffer(data.ljust(SYMBOLS, b"\0"), np.uint8)[None, :])[0]
    return _nt(word[:-FREE]) + "".join(b * times for b in _nt(word[-FREE:]))


def decode_repeated(dna: str, times: int = 3) -> tuple[bytes, bool]:
    head, tail = dna[: PER * SYMBOLS], dna[PER * SYMBOLS :]
    voted = "".join(max(sorted(set(tail[i : i + times])), key=tail[i : i + times].count) for i in range(0, len(tail), times))
    if len(head) != PER * SYMBOLS or len(voted) != PER * FREE:
        return bytes(SYMBOLS), False
    fixed = code(FREE).correct(np.concatenate((_symbols(head), _symbols(voted))))
    return (bytes(SYMBOLS), False) if fixed is None else (fixed[:SYMBOLS].astype(np.uint8).tobytes(), True)


def success_probability(p: float, n: int = LENGTH) -> float:
    """Chance that at most one base of n is edited: a lower bound of what decoding repairs."""
    return (1 - p) ** n + n * p * (1 - p) ** (n - 1)


def code_rate(symbols: int = SYMBOLS, per: int = PER, parities: int = FREE, check: int = CHECK_NT) -> float:
    """Payload bases over strand bases."""
    return symbols * per / ((symbols + parities) * per + check)
