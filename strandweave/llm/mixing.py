"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key divided by its quality weight. Within a
source, documents in key order are prefix-summed up to the source's token
budget. Complete epochs come first: a budget of 2.4 times the source takes each
document twice, then selects 0.4 of the source.

The prefix sum never sorts a whole source: sizes are summed by (source, key
bin), bins are prefix-summed, and the bin that the budget ends in is cut again
until it is small; only that is sorted. That gives one threshold row per source,
so selecting is map-side. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialise, maybe_broadcast, numbered

WEIGHTS = (1, 2, 3)
#: No source is repeated more often.
EPOCHS = 3
SEED = 42
#: Rows that the sorted bin of a source holds at most; bins that a round cuts a range of keys into.
BIN_ROWS, BINS = 4_000, 1024
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def quality_of(text: Column) -> Column:
    """Share of characters other than symbols typical of markup and junk, at least a quarter."""
    n = F.char_length(text)
    junk = n - F.char_length(F.translate(text, "#*$%&|<>{}[]=~^_\\", ""))
    return F.when(n > 0, F.greatest(F.lit(0.25), 1 - 4 * junk / n)).otherwise(F.lit(1.0))


def key_of(doc_id: Column, weight: Column, seed: int = SEED) -> Column:
    """-ln(u) / weight; u comes from a hash of the id, so reruns agree."""
    u = (F.shiftrightunsigned(F.xxhash64(doc_id.cast("long"), F.lit(seed)), 11).cast("double") + 0.5) / float(2**53)
    return -F.log(u) / F.greatest(F.coalesce(weight, F.lit(1.0)), F.lit(1e-6))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size -> with target: shares of the total by weight, at most `epochs` times the source.

    Sources in code-point order, null last, weigh 1, 2, 3, repeating. The excess
    over a stop is reshared by weight until none is above: every round is one
    sum over all sources, and no task holds them all.
    """
    rank = numbered(sizes, "rank", F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    s = materialise(rank.select("source", "source_size", w.alias("w"), (F.col("source_size").cast("double") * epochs).alias("stop")), "weights")
    whole = s.agg(F.sum(F.col("source_size").cast("double")).alias("n"), F.sum("w").alias("w")).first()
    total, level, before = whole["n"] or 0.0, (whole["n"] or 0.0) / (whole["w"] or 1.0), -1
    while True:
        above = F.col("stop") < F.col("w") * level
        got = s.agg(F.count_if(above).alias("k"), F.sum(F.when(above, F.col("stop"))).alias("stops"), F.sum(F.when(~above, F.col("w"))).alias("w")).first()
        if got["k"] == before or not got["w"]:
            break
        before, level = got["k"], (total - (got["stops"] or 0.0)) / got["w"]
    return s.select("source", "source_size", F.least(F.col("stop"), F.col("w") * level).alias("target"))


def _same(df: DataFrame, side: DataFrame, *more: Column, how: str = "inner") -> DataFrame:
    """df with side's row of its source (there s), broadcast if few."""
    on = F.col("source").eqNullSafe(F.col("s"))
    for m in more:
        on = on & m
    return df.join(maybe_broadcast(side), on, how)


def borders(rows: DataFrame, goal: DataFrame, bin_rows: int = BIN_ROWS, bins: int = BINS) -> DataFrame:
    """rows (source, size, key), goal (source, budget, n, lo, hi) -> s, budget, before, lo, hi: the keys among which each source's budget ends, and the size below them.

    Keys from lo to hi, the least and largest, are cut into bins of one width;
    the bin that the budget ends in is cut again until it holds bin_rows rows at
    most, or one key. So the bound holds for any distribution of keys.
    """
    state = materialise(goal.select(F.col("source").alias("s"), "budget", F.lit(0).cast("long").alias("before"), "n", "lo", "hi"), "borders")
    wide = (F.col("n") > bin_rows) & (F.col("hi") > F.col("lo"))
    inside = F.col("key").between(F.col("lo"), F.col("hi"))
    while not (todo := state.filter(wide)).isEmpty():
        at = F.least(F.floor((F.col("key") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
        sums = _same(rows, todo, inside).groupBy("s", "budget", "before", at.alias("bin")).agg(
            F.sum("size").alias("size"), F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")
        )
        along = Window.partitionBy("s").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        upto = sums.withColumn("upto", F.col("before") + F.sum("size").over(along)).filter(F.col("upto") > F.col("budget"))
        first = upto.groupBy("s", "budget").agg(F.min(F.struct("bin", (F.col("upto") - F.col("size")).alias("before"), "n", "lo", "hi")).alias("x"))
        state = materialise(state.filter(~wide).unionByName(first.select("s", "budget", "x.before", "x.n", "x.lo", "x.hi")), "borders")
    return state


def thresholds(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS, bin_rows: int = BIN_ROWS, bins: int = BINS) -> DataFrame:
    """rows (doc_id, source, size, key) -> per source: source_size, target, epochs, cut_key, cut_unnamed, cut_id.

    A document is taken `epochs` times, and once more if (key, id) is at most
    the cut. Only keys of the border bins are sorted, repeated ids as one.
    """
    stats = materialise(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")), "sources")
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = targets(stats.select("source", "source_size"), weights, epochs).withColumn("epochs", F.least(times, F.lit(epochs)))
    goal = goal.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    goal = materialise(_same(goal, stats.select(F.col("source").alias("s"), "n", "lo", "hi")).drop("s"), "targets")
    ends = borders(rows, goal, bin_rows, bins)
    border = _same(rows, ends.drop("n"), F.col("key").between(F.col("lo"), F.col("hi"))).groupBy("source", "budget", "before", "lo", "key", "doc_id").agg(F.sum("size").alias("size"))
    inside = Window.partitionBy("source").orderBy("key", F.col("doc_id").isNull(), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Of the document that the budget ends in, the nearer side is chosen.
    fits = F.col("before") + F.sum("size").over(inside) - F.col("size") / 2 <= F.col("budget")
    last = F.max(F.when(F.col("fits"), F.struct("key", F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"))))
    cut = border.withColumn("fits", fits).groupBy("source").agg(last.alias("cut"), F.min("lo").alias("low")).select(F.col("source").alias("s"), "cut", "low")
    # No document of the border fits: the cut is below its first key.
    return _same(goal, materialise(cut, "cuts"), how="left").select(
        "source", "source_size", "target", "epochs", F.coalesce(F.col("cut.key"), F.col("low")).alias("cut_key"),
        F.coalesce(F.col("cut.unnamed"), F.lit(False)).alias("cut_unnamed"), F.when(F.col("cut").isNull(), F.lit(-(2**63))).otherwise(F.col("cut.id")).alias("cut_id"),
    )


def _taken_times(key: Column, doc_id: Column, cut: Column | None = None) -> Column:
    """How often a document is taken; the cut's columns are in a struct or in the row."""
    of = (lambda c: F.col(c)) if cut is None else (lambda c: cut[c])
    more = F.struct(key.alias("a"), doc_id.isNull().alias("b"), doc_id.alias("c")) <= F.struct(of("cut_key").alias("a"), of("cut_unnamed").alias("b"), of("cut_id").alias("c"))
    return of("epochs") + F.when(of("cut_key").isNotNull() & more, 1).otherwise(0)


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED, bin_rows: int = BIN_ROWS, bins: int = BINS) -> DataFrame:
    """Per document: doc_id (whole numbers), size, source_size, target, taken (words, repeats counted).

    Null text has size 0 and is never taken. Null source is a source of its own,
    last in order. Rows that repeat one id share one key and fate, and count as
    one at a source's end; ties of keys go by id, null last. An empty table
    gives an empty result. Each source's taken words miss its target by at most
    half of the document that the budget ends in. No document is taken more than
    `epochs` times. Other columns are ignored. A very long text is one row whose
    words are counted in one pass.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", size_of(text).alias("size"), key_of(F.col("doc_id"), quality_of(text), seed).alias("key"))
    rows = materialise(rows, "sizes")
    cuts = materialise(thresholds(rows, weights, epochs, bin_rows, bins).withColumnRenamed("source", "s"), "thresholds")
    return _same(rows, cuts, how="left").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * _taken_times(F.col("key"), F.col("doc_id"))).cast("long").alias("taken")
    )


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED, bin_rows: int = BIN_ROWS) -> DataFrame:
    """The mix itself: rows of docs, each as often as the mix takes it; documents without words go.

    Nulls, ties, repeated rows, empty tables and very long texts as in mix_plan.
    Words are counted once; the second pass over the texts asks only for one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key, cut, of, again = (fresh(docs, x) for x in ("key", "cut", "of", "again"))
    keyed = docs.withColumn(key, key_of(F.col("doc_id"), quality_of(text), seed))
    rows = materialise(keyed.select("doc_id", "source", size_of(text).alias("size"), F.col(key).alias("key")), "sizes")
    cuts = thresholds(rows, weights, epochs, bin_rows)
    cuts = materialise(cuts.select(F.col("source").alias(of), F.struct("epochs", "cut_key", "cut_unnamed", "cut_id").alias(cut)), "thresholds")
    joined = keyed.filter(text.rlike(WORD)).join(maybe_broadcast(cuts), F.col("source").eqNullSafe(F.col(of)))
    n = _taken_times(F.col(key), F.col("doc_id"), F.col(cut)).cast("int")
    return joined.withColumn(again, F.explode(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")))).select(*[F.col(f"`{c}`") for c in docs.columns])
