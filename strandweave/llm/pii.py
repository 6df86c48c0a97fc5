"""Personal data spans: base patterns, plus candidates selected by boosted trees.

High-recall generators propose overlapping spans that the base patterns miss
(telephone numbers without a plus, cards of other lengths or with a wrong check
digit, spelled-out addresses, IPv6, keys and tokens). Boosted trees over format
and context features, on both sides, score them; thresholds calibrated for
precision per kind select. DataFrame functions only: every pattern marks its
matches in one pass, and positions are running sums of piece lengths. All
quantifiers are possessive or bounded, so no text backtracks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits
from . import boosting
from .pii_model import CONTEXT, GENERATORS, GROUPS, KINDS, LEFT, LOCAL, NUMBER_CHARS, NUMBER_DIGITS, RIGHT, models

#: Kinds of base spans.
BASE_KINDS = KINDS[:4]
MARK = "\x01"
#: Leftmost non-overlapping matches as the plain patterns have them: \\G lets a match start where the last one ended.
BASE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(s: Column) -> Column:
    return F.translate(s, UPPER, LOWER)


def _running_starts(lens: Column) -> Column:
    """Where each piece starts: sums over blocks of 64, then within the block, so many matches stay cheap."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lens) - 1) / 64).cast("int")), lambda b: total(F.slice(lens, b * 64 + 1, 64)))
    return F.transform(
        F.sequence(F.lit(0), F.size(lens) - 1),
        lambda i: total(F.slice(blocks, 1, F.floor(i / 64).cast("int"))) + total(F.slice(lens, (F.floor(i / 64) * 64 + 1).cast("int"), (i % 64).cast("int"))),
    )


def _add_spans(df: DataFrame, text: str, pattern: str, name: str, only_if: Column | None = None) -> DataFrame:
    """Add name: array of (s, e, m, c, r) of the pattern's matches; c and r are the text before and after, up to CONTEXT characters, to the next match, lower-cased."""
    marked = F.regexp_replace(F.col(text), F.lit(pattern), F.lit(f"{MARK}$0{MARK}"))
    if only_if is not None:
        marked = F.when(only_if, marked).otherwise(F.lit(""))
    kind = "array<struct<s:int,e:int,m:string,c:string,r:string>>"
    df = df.withColumn(f"{name}_p", F.split(marked, MARK, -1))
    some = F.size(f"{name}_p") > 1
    df = df.withColumn(f"{name}_l", F.when(some, F.transform(f"{name}_p", lambda x: F.char_length(x))))
    df = df.withColumn(f"{name}_s", F.when(some, _running_starts(F.col(f"{name}_l"))))
    part, at, size = F.col(f"{name}_p"), F.col(f"{name}_s"), F.col(f"{name}_l")
    spans = F.transform(
        F.sequence(F.lit(2), F.size(part), F.lit(2)),
        lambda i: F.struct(
            F.element_at(at, i).alias("s"),
            (F.element_at(at, i) + F.element_at(size, i)).alias("e"),
            F.element_at(part, i).alias("m"),
            _lower(F.right(F.element_at(part, i - 1), F.lit(CONTEXT))).alias("c"),
            _lower(F.left(F.element_at(part, i + 1), F.lit(CONTEXT))).alias("r"),
        ),
    )
    return df.withColumn(name, F.coalesce(F.when(some, spans), F.array().cast(kind))).drop(f"{name}_p", f"{name}_l", f"{name}_s")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"[^0-9]", "")


def _luhn(d: Column) -> Column:
    n = F.char_length(d)
    doubled = lambda i: F.substring(d, n - i, F.lit(1)).cast("int") * (1 + i % 2)
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + doubled(i) - F.when(doubled(i) > 9, 9).otherwise(0))
    return (n > 0) & (total % 10 == 0)


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = lambda x: F.ltrim(x, F.lit("0"))
        return F.forall(F.split(m, r"\."), lambda x: (F.char_length(part(x)) < 3) | ((F.char_length(part(x)) == 3) & (part(x) <= "255")))
    if kind == "card":
        return _luhn(_digits(m))
    if kind == "phone":
        return F.char_length(_digits(m)).between(8, 15)
    return F.lit(True)


def features(x: Column) -> list[Column]:
    """Of a candidate (m, c, r), as pii_model.features_of has them."""
    m, c, r = x["m"], x["c"], x["r"]
    count = lambda chars: F.char_length(m) - F.char_length(F.translate(m, chars, ""))
    flag = lambda b: F.when(b, 1).otherwise(0)
    digits = count("0123456789")
    shape = [
        digits, F.char_length(m), F.char_length(m) - digits, flag(_luhn(_digits(m))), flag(F.contains(m, F.lit("@"))), flag(m.rlike(r"\(at\)|\[at\]| at ")), count("."), F.size(F.split(m, r"[^0-9]+")), count("("), count(":"),
        count("+"), count(UPPER + LOWER), count(UPPER), flag(m.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")), count("-"),
    ]
    return [*shape, *[flag(c.rlike(p)) for p in LEFT.values()], *[flag(r.rlike(p)) for p in RIGHT.values()]]


def _valid_span(kind: str) -> Callable[[Column], Column]:
    return lambda x: _valid(kind, x["m"])


def _as_kind(k: Column) -> Callable[[Column], Column]:
    return lambda x: F.struct(k.alias("k"), x["s"].alias("s"), x["e"].alias("e"))


def _number_candidates(x: Column) -> Column:
    """Overlapping parts of a run of digit groups, as pii_model.number_parts has them."""
    m = x["m"]
    digit = lambda i: F.substring(m, i, F.lit(1)).between("0", "9")
    places = F.sequence(F.lit(1), F.char_length(m))
    starts = F.filter(places, lambda i: digit(i) & ((i == 1) | ~digit(F.greatest(i - 1, F.lit(1)))))
    ends = F.filter(places, lambda i: digit(i) & ~digit(i + 1))
    signed = lambda a: (a > 1) & F.substring(m, F.greatest(a - 1, F.lit(1)), F.lit(1)).isin("(", "+")
    spans = F.zip_with(starts, ends, lambda a, b: F.struct((a - F.when(signed(a), 1).otherwise(0)).alias("a"), b.alias("b")))

    def cut(all_: Column) -> Column:
        parts = F.transform(all_, lambda g, i: F.transform(F.slice(all_, i + 1, F.lit(GROUPS)), lambda h: F.struct(g["a"].alias("a"), h["b"].alias("b"))))
        fit = F.filter(F.flatten(parts), lambda h: (h["b"] - h["a"] + 1).between(*NUMBER_CHARS) & ~F.substring(m, h["b"] + 1, F.lit(1)).rlike("[A-Za-z]"))
        before = lambda h: F.concat(x["c"], _lower(F.left(m, h["a"] - 1)))
        after = lambda h: F.concat(_lower(F.substring(m, h["b"] + 1, F.char_length(m))), x["r"])
        made = F.transform(
            fit,
            lambda h: F.struct(
                (x["s"] + h["a"] - 1).alias("s"), (x["s"] + h["b"]).alias("e"), F.substring(m, h["a"], h["b"] - h["a"] + 1).alias("m"),
                F.right(before(h), F.lit(CONTEXT)).alias("c"), F.left(after(h), F.lit(CONTEXT)).alias("r"),
            ),
        )
        return F.filter(made, lambda h: ~h["m"].rlike("[() .-]{4}") & F.char_length(_digits(h["m"])).between(*NUMBER_DIGITS))

    return bits.let(spans, cut)


def _best(scored: Column) -> Column:
    """Non-overlapping spans of arrays (score, s, e, k, mixed): those of one separator first, then by score, the longer, the first."""
    order = F.array_sort(F.transform(scored, lambda x: F.struct(x["mixed"].alias("x"), (-x["score"]).alias("o"), (x["s"] - x["e"]).alias("l"), x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))
    none = F.array().cast("array<struct<k:int,s:int,e:int>>")
    return F.aggregate(order, none, lambda kept, x: F.when(F.exists(kept, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])), kept).otherwise(F.concat(kept, F.array(F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"))))))


def find_spans(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: id, base and all, arrays of (kind index in KINDS, s, e) in order; code points, e exclusive.

    Null and empty texts have no spans. Base spans stay whatever the model says;
    a candidate that overlaps a base span is that span's and is not added. Of
    overlapping candidates over their thresholds those of one separator go first,
    then those of the highest score over the threshold. Repeated rows and null
    ids are rows like others; other columns are ignored. An empty table gives
    an empty result. A very long text is one row: patterns pass over it once,
    and the work on a number run grows with the square of its length.
    """
    # A mark in the text itself would be taken for ours; U+0002 is as foreign to all patterns.
    df = docs.select(F.col(id_col).alias("doc_id"), F.translate(F.coalesce(F.col(text_col), F.lit("")), MARK, "\x02").alias("t"))
    number = F.col("t").rlike("[0-9]")
    gates = {"email": F.col("t").contains("@"), "ip": number & F.col("t").contains("."), "card": number, "phone": F.col("t").contains("+")}
    for kind, pattern in BASE.items():
        df = _add_spans(df, "t", pattern, f"b_{kind}", gates[kind])
        df = df.withColumn(f"b_{kind}", F.filter(f"b_{kind}", _valid_span(kind)))
    tests = {"email": F.col("t").rlike(r"@| at |\(at\)|\[at\]"), "ip": F.col("t").contains(":"), "number": number, "secret": number}
    for g, pattern in GENERATORS.items():
        df = _add_spans(df, "t", pattern, f"g_{g}", tests[g])
    base = F.concat(*[F.transform(f"b_{k}", _as_kind(F.lit(i))) for i, k in enumerate(BASE_KINDS)])
    df = df.withColumn("base", F.array_sort(base))
    free = lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
    df = df.withColumn("g_number", F.flatten(F.transform("g_number", _number_candidates)))
    extra = []
    for g in GENERATORS:
        trees, cut = models()[g]
        mixed = lambda x: x["m"].rlike("[0-9] [0-9]") & x["m"].rlike("[0-9][.-][0-9]")
        scored = F.transform(F.filter(f"g_{g}", free), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), mixed(x).alias("mixed"), F.array(*features(x)).alias("f")))
        kind = f"CASE WHEN x.f[0] >= 13 THEN {KINDS.index('card')} ELSE {KINDS.index('phone')} END" if g == "number" else str(KINDS.index(g))
        over = f"{boosting.as_sql(trees, lambda j: f'x.f[{j}]')} - {cut!r}D"
        df = df.withColumn(f"f_{g}", scored)
        df = df.withColumn(f"x_{g}", F.expr(f"transform(f_{g}, x -> struct({over} AS score, x.s AS s, x.e AS e, {kind} AS k, x.mixed AS mixed))"))
        extra.append(F.filter(f"x_{g}", lambda x: x["score"] >= 0))
    return df.select("doc_id", "base", F.array_sort(F.array_distinct(F.concat("base", _best(F.concat(*extra))))).alias("all"))


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["k"] == KINDS.index(kind))).cast("long")
