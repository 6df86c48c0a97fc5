"""Column functions over bit strings, digits and plain strings. JVM-side but for the byte kernels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .kernels import bits_to_bytes, bytes_to_bits  # noqa: F401

HEX = "0123456789abcdef"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once: a lambda would work out what it uses again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def replace_digits(hexed: Column, codes: list[str]) -> Column:
    """Each lower-case hex digit by its code; codes must not contain digits or a to f."""
    for digit, code in zip(HEX, codes, strict=True):
        hexed = F.replace(hexed, F.lit(digit), F.lit(code))
    return hexed


def bits_to_hex(bits: Column) -> Column:
    """Hex digits of a bit string, right-padded with 0 to a multiple of four; 32 bits at a time."""


    def block(part: Column) -> Column:
        return F.lpad(F.lower(F.conv(part, 2, 16)), (F.char_length(part) / 4).cast("int"), F.lit("0"))

    whole = let(bits, lambda b: F.rpad(b, (F.ceil(F.char_length(b) / 4) * 4).cast("int"), F.lit("0")))
    return F.array_join(F.transform(pieces(whole, 32), block), "")


def digits(n: Column, base: int, width: int) -> Column:
    """n in the base, big-endian, exactly width digits: padded with 0, cut on the left."""
    full = F.lower(F.conv(n.cast("string"), 10, base))
    return F.right(F.concat(F.lit("0" * width), full), F.lit(width))


def convert_base(s: Column, base_from: int, base_to: int) -> Column:
    return F.lower(F.conv(s, base_from, base_to))


def pieces(s: Column, k: int) -> Column:
    """Consecutive pieces of k characters, the last may be shorter; none of an empty string. One pass: a substring per piece would scan from the start."""
    return F.regexp_extract_all(s, F.lit(f"(?s).{{1,{k}}}"), F.lit(0))


def chars(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0))


def alternating_pieces(s: Column, a: int, b: int) -> Column:
    """Pieces of a, b, a, b, ... characters."""

    def cut(t: Column) -> Column:
        n = F.char_length(t)
        pairs = F.transform(F.sequence(F.lit(1), n, F.lit(a + b)), lambda i: F.array(F.substring(t, i, F.lit(a)), F.substring(t, i + a, F.lit(b))))
        return F.when(n > 0, F.filter(F.flatten(pairs), lambda x: x != "")).otherwise(F.array().cast("array<string>"))

    return let(s, cut)


def split_at(s: Column, n: int) -> Column:
    return F.array(F.substring(s, 1, n), F.substring(s, F.lit(n + 1), F.char_length(s)))


def xor(a: Column, b: Column) -> Column:
    """Bitwise difference of two bit strings of one length."""
    return F.array_join(F.zip_with(chars(a), chars(b), lambda x, y: F.when(x == y, "0").otherwise("1")), "")


def diff_positions(a: Column, b: Column) -> Column:
    """Positions from 0 at which the common prefix length of two strings differs."""

    differ = F.zip_with(chars(a), chars(b), lambda x, y: x.isNotNull() & y.isNotNull() & (x != y))
    marked = F.transform(differ, lambda d, i: F.when(d, i))
    return F.filter(marked, lambda i: i.isNotNull())


def hamming(a: Column, b: Column) -> Column:
    """Differing positions over the shorter length plus the difference in length."""
    return F.size(diff_positions(a, b)) + F.abs(F.char_length(a) - F.char_length(b))


def limbs(dna: Column, length: int) -> Column:
    """One-hot limbs of 15 bases: distance of two strands of one length is half the set bits of their XOR."""
    one = F.translate(dna, "ACGT", "1248")
    return F.array(*[F.conv(F.substring(one, i, 15), 16, 10).cast("long") for i in range(1, length + 1, 15)])


def limb_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x) / 2


def leading_zero(bits: Column, n: int) -> Column:
    return F.left(bits, F.lit(n)) == "0" * n


def leading_int(bits: Column, n: int) -> Column:
    return F.conv(F.left(bits, F.lit(n)), 2, 10).cast("long")


def flatten_layers(nested: Column, layers: int) -> Column:
    """A nested array with its outer layers of nesting taken away."""
    for _ in range(layers):
        nested = F.flatten(nested)
    return nested


def transpose(rows: Column) -> Column:
    """Columns of an array of arrays, as far as its shortest row reaches."""

    def turned(m: Column) -> Column:
        width = F.array_min(F.transform(m, F.size))
        return F.when(width > 0, F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.transform(m, lambda r: F.get(r, i)))).otherwise(F.slice(m, 1, 0))

    return let(rows, turned)
