"""Column functions over nucleotide strings. JVM-side but for the byte kernels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .bits import let, pieces
from .kernels import bytes_to_dna, dna_to_bytes, mapped

#: Two bits a base, in counting order of each mapping. Fixed values.
DENSE = "AGCT"
PACKED = "ACGT"


def valid(s: Column) -> Column:
    return s.rlike("^[ACGT]+$")


def complement(s: Column) -> Column:
    return F.translate(s, "ACGT", "TGCA")


def reverse_complement(s: Column) -> Column:
    return F.reverse(complement(s))


def canonical(s: Column) -> Column:
    """The lesser of a strand and its reverse complement."""
    return F.least(s, reverse_complement(s))


def count_base(s: Column, base: str) -> Column:
    return F.char_length(s) - F.char_length(F.replace(s, F.lit(base), F.lit("")))


def gc_count(s: Column) -> Column:
    return F.char_length(s) - F.char_length(F.translate(s, "GC", ""))


def gc_fraction(s: Column) -> Column:
    """Null for an empty strand."""
    n = F.char_length(s)
    return F.when(n > 0, gc_count(s) / n)


def runs(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit("(A+|C+|G+|T+)"), F.lit(1))


def longest_run(s: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(runs(s), lambda x: F.char_length(x))), F.lit(0))


def one_base(s: Column) -> Column:
    return s.rlike(r"^(.)\1*$")


def pieces_every(s: Column, width: int, step: int) -> Column:
    """Pieces of a width that start every `step` characters."""
    return let(s, lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(t), F.lit(1)), F.lit(step)), lambda i: F.substring(t, i, F.lit(width))))


def windows_ok(s: Column, max_run: int, gc_min: float, gc_max: float, window: int = 150, step: int = 140) -> Column:
    """Every window keeps to the longest run and the GC range."""

    def bad(w: Column) -> Column:
        gc = gc_count(w) / F.char_length(w)
        return (longest_run(w) > max_run) | (gc < gc_min) | (gc > gc_max)

    return (F.char_length(s) > 0) & ~F.exists(pieces_every(s, window, step), bad)


def melting_point(s: Column) -> Column:
    """Wallace rule for strands under 25 bases; null for longer ones."""
    return F.when(F.char_length(s) < 25, 4 * gc_count(s) + 2 * (F.char_length(s) - gc_count(s)))


def stable_end(s: Column, tail: int = 8, run: int = 4) -> Column:
    """No run of `run` equal bases in the last `tail`."""
    return ~F.right(s, F.lit(tail)).rlike("|".join(b * run for b in "ACGT"))


def dna_to_hex(dna: Column, order: str = DENSE) -> Column:
    """Hex digits of base pairs, 16 bases at a time; an odd last base is padded with 0."""


    def block(part: Column) -> Column:
        return F.lpad(F.lower(F.conv(part, 4, 16)), (F.char_length(part) / 2).cast("int"), F.lit("0"))

    whole = let(F.translate(dna, order, "0123"), lambda q: F.rpad(q, (F.ceil(F.char_length(q) / 2) * 2).cast("int"), F.lit("0")))
    return F.array_join(F.transform(pieces(whole, 16), block), "")


def pack(dna: Column) -> Column:
    """Two bits a base in a binary column, zero-filled to whole bytes; keep the length beside it."""
    return let(dna, lambda s: F.unhex(dna_to_hex(F.rpad(s, (F.ceil(F.char_length(s) / 4) * 4).cast("int"), F.lit("A")), PACKED)))


def unpack(packed: Column, length: Column) -> Column:
    return F.left(bytes_to_dna(packed, PACKED), length)


def kmers(s: Column, k: int) -> Column:
    """All overlapping pieces of k bases, in order, in one pass."""
    return F.regexp_extract_all(s, F.lit(f"(?=([ACGTN]{{{k}}}))"), F.lit(1))


def alternating(bits: Column, codes: tuple[str, str] = ("TG", "CA")) -> Column:
    """One bit a base; even positions use the first pair of bases, odd ones the second."""
    table = np.frombuffer("".join(codes).encode(), np.uint8)

    def run(data: np.ndarray, bounds: np.ndarray, valid: np.ndarray | None) -> tuple:
        place = np.arange(len(data)) - np.repeat(bounds[:-1], np.diff(bounds))
        return table[place % 2 * 2 + (data == ord("1"))], bounds, valid

    return mapped("alternating", "string", run)(bits)
