"""Read processing: grouping, clustering, consensus. read: payload_id, ..., seq, ord (a stable ordinal)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bits
from ..functions.kernels import column_of, flat
from ..scratch import is_small, maybe_broadcast


def barcode(seq: Column, width: int) -> Column:
    return F.left(seq, F.lit(width))


def normalise_length(seq: Column, length: int, pad: str = "N") -> Column:
    """Cut or padded to the length."""
    return F.rpad(seq, length, pad)


def strip_spaces(seq: Column) -> Column:
    return F.replace(seq, F.lit(" "), F.lit(""))


def repair_length(reads: DataFrame, length: int, seed: int = 0, seq: str = "seq") -> DataFrame:
    """Bases inserted or deleted at hash-drawn places until the length is right."""
    from ..functions import rng

    n = F.char_length(seq)
    key = [F.col("payload_id"), F.col("ord")]

    def step(s: Column, j: Column) -> Column:
        m = F.char_length(s)
        at = (F.floor(rng.fast_uniform(F.lit(seed), *key, j) * F.greatest(m, F.lit(1))) + 1).cast("int")
        base = F.substring(F.lit("ACGT"), (F.floor(rng.fast_uniform(F.lit(seed), F.lit("b"), *key, j) * 4) + 1).cast("int"), F.lit(1))
        more = F.concat(F.substring(s, F.lit(1), at - 1), base, F.substring(s, at, m))
        less = F.concat(F.substring(s, F.lit(1), at - 1), F.substring(s, at + 1, m))
        return F.when(n < length, more).otherwise(less)

    fixed = F.aggregate(F.sequence(F.lit(1), F.abs(n - length)), F.col(seq), step)
    return reads.withColumn(seq, F.when(n == length, F.col(seq)).otherwise(fixed))


def repair_classes(reads: DataFrame, length: int, seed: int = 0, seq: str = "seq", classes: tuple[str, str] = ("TG", "CA")) -> DataFrame:
    """Strands whose bases alternate between two classes, set right in one pass: the length and the class of every place.

    A base of the wrong class marks where one was lost, gained or replaced. A
    strand that is too short gets a drawn base before it, one that is too long
    loses it, others get a drawn base in its place. A single lost base thus
    leaves all others in their places. Drawn by payload_id, ord and place.
    """
    from ..functions import rng

    key = [F.col("payload_id"), F.col("ord")]
    clean = strip_spaces(F.coalesce(F.col(seq), F.lit("")))
    wanted = lambda i: F.when(i % 2 == 0, classes[0]).otherwise(classes[1])
    drawn = lambda i: F.substring(wanted(i), (F.floor(rng.fast_uniform(F.lit(seed), *key, i) * 2) + 1).cast("int"), F.lit(1))

    def step(acc: Column, c: Column) -> Column:
        i, out, off = F.char_length(acc["out"]), acc["out"], acc["off"]
        good, base = F.instr(wanted(i), c) > 0, F.instr(F.lit("".join(classes)), c) > 0
        lost, gained = ~good & base & (off > 0), ~good & (off < 0)
        added = F.when(good, c).when(lost, F.concat(drawn(i), c)).when(gained, F.lit("")).otherwise(drawn(i))
        return F.struct(F.concat(out, added).alias("out"), (off - lost.cast("int") + gained.cast("int")).alias("off"))

    start = F.struct(F.lit("").alias("out"), (F.lit(length) - F.char_length(clean)).alias("off"))
    body = F.left(F.aggregate(bits.chars(clean), start, step)["out"], F.lit(length))
    rest = lambda s: F.concat(s, F.when(F.char_length(s) < length, F.array_join(F.transform(F.sequence(F.char_length(s), F.lit(length - 1)), drawn), "")).otherwise(""))
    return reads.withColumn(seq, bits.let(body, rest))


def group_by_first(rows: DataFrame, n: int, items: str = "items") -> DataFrame:
    """Rows whose first n items are numbers, with key (those items) and n_group, the rows that share them."""
    head = F.slice(items, 1, n)
    keyed = rows.filter(F.forall(head, lambda x: F.coalesce(x.rlike("^-?[0-9]+$"), F.lit(False)))).withColumn("key", head)
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n_group"))
    return keyed.join(sizes, "key")


def voted_and_single(reads: DataFrame, keys: list[str], seq: str = "seq", order: str = "ord") -> DataFrame:
    """Distinct reads, all of them: codes whose reads carry their own checks need those seen once too. Adds n, ord and voted (seen twice or more)."""
    return distinct_reads(reads, keys, seq, order).withColumn("voted", F.col("n") >= 2)


def process_metrics(reads: DataFrame, called: DataFrame, keys: list[str]) -> DataFrame:
    """One row: reads in, groups, reads out, and how many fewer those are."""
    before = reads.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_in"), F.count("*").alias("n_groups"))
    return before.join(F.broadcast(called.agg(F.count("*").alias("n_out"))), F.lit(True)).withColumn("n_removed", F.col("n_in") - F.col("n_out"))


def mad_filter(reads: DataFrame, keys: list[str], width: float = 5.0) -> DataFrame:
    """Reads of groups whose size is within median +- width * MAD of the sizes; adds n_group. The medians are exact."""
    sizes = reads.groupBy(*keys).agg(F.count("*").alias("n_group"))
    mid = sizes.agg(F.percentile("n_group", F.lit(0.5)).alias("mid"))
    off = sizes.join(F.broadcast(mid), F.lit(True)).agg(F.percentile(F.abs(F.col("n_group") - F.col("mid")), F.lit(0.5)).alias("mad"), F.max("mid").alias("mid"))
    good = sizes.join(F.broadcast(off), F.abs(F.col("n_group") - F.col("mid")) <= width * F.col("mad")).select(*keys, "n_group")
    return reads.join(good, keys)


#: Reads of a group that one task votes on at most; larger groups are voted by aggregates.
VOTED = 100_000


def consensus(reads: DataFrame, keys: list[str], seq: str = "seq", order: str = "ord", only: str | None = "ACGT", most: int | None = None) -> DataFrame:
    """Per group and position the most frequent base; ties go to the base seen first. -> keys, seq, n_reads.

    Positions where no read has an allowed base get A. Equal reads of a group
    that are near each other are counted before, and those of a group cross one
    exchange as one row; whole batches are voted on at once; what a task holds
    is a batch and the counts of one group. Finding groups too large for that makes
    the reads once more, unless most says how many a group can have.
    """
    if only != "ACGT":
        return _consensus_by_rows(reads, keys, seq, order, only)
    rows = reads.select(*keys, F.coalesce(F.col(seq), F.lit("")).alias(seq), F.col(order).cast("long").alias(order))
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField(seq, T.StringType()), T.StructField("n_reads", T.LongType())])
    counted = T.StructType([*schema.fields[: len(keys)], T.StructField("seqs", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("firsts", T.ArrayType(T.LongType()))])
    vote = lambda df: df.mapInArrow(_counter(len(keys), counted.names), counted).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_voter(len(keys), schema.names), schema)
    if most is not None and most <= VOTED:
        return vote(rows)
    large = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > VOTED).select(*keys)
    if large.isEmpty():
        return vote(rows)
    few = maybe_broadcast(large)
    return vote(rows.join(few, keys, "left_anti")).unionByName(_consensus_by_rows(rows.join(few, keys, "left_semi"), keys, seq, order, only))


#: Reads among which equal ones are counted.
NEAR = 1 << 16


def _counter(n_keys: int, names: list[str]):
    """Rows (keys, seq, ord) -> one row for each group among NEAR reads: its distinct reads, how often each is there, and its least ordinal."""

    def counted(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        keys = [f"k{i}" for i in range(n_keys)]
        one = table.rename_columns([*keys, "seq", "ord"]).group_by([*keys, "seq"], use_threads=False).aggregate([("ord", "min"), ([], "count_all")])
        rows = one.group_by(keys, use_threads=False).aggregate([("seq", "list"), ("count_all", "list"), ("ord_min", "list")])
        columns = [*keys, "seq_list", "count_all_list", "ord_min_list"]
        return pa.RecordBatch.from_arrays([rows[c].combine_chunks() for c in columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if held and sum(b.num_rows for b in held) + batch.num_rows > NEAR:
                yield counted(held)
                held = []
            held.append(batch)
        if held and sum(b.num_rows for b in held):
            yield counted(held)

    return run


def _spread_out(batch: pa.RecordBatch, n_keys: int) -> pa.Table:
    """Rows in order of keys (keys, seqs, counts, firsts) -> one row a distinct read (keys, seq, ord, n), in order of keys and ordinal."""
    lists = [batch.column(n_keys + k) for k in range(3)]
    rows = pa.array(np.repeat(np.arange(batch.num_rows), np.array(pc.list_value_length(lists[0]))))
    table = pa.table([*[batch.column(k).take(rows) for k in range(n_keys)], *[lists[k].flatten() for k in (0, 2, 1)]], names=[*[f"k{i}" for i in range(n_keys)], "seq", "ord", "n"])
    starts = _group_starts(table, n_keys)
    group = np.searchsorted(starts, np.arange(table.num_rows), "right")
    return table.take(pa.array(np.lexsort((np.array(table["ord"]), group))))


def _voter(n_keys: int, names: list[str]):
    """Rows of _counter() in order of keys -> one row a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            table = table.combine_chunks()
            starts = _group_starts(table, n_keys)
            last = int(starts[-1]) if len(starts) else 0
            # A few hundred groups at a time: their bases stay in the cache.
            cuts = [*starts[:-1:GROUPS].tolist(), last] if last else []
            for x, y in zip(cuts, cuts[1:], strict=False):
                yield _counted_votes(table.slice(x, y - x), n_keys, names)
            rest = table.slice(last)
        if rest is not None and rest.num_rows:
            yield _counted_votes(rest, n_keys, names)

    return run


#: Groups that are voted on at a time.
GROUPS = 1 << 9


def _counted_votes(table: pa.Table, n_keys: int, names: list[str]) -> pa.RecordBatch:
    spread = _spread_out(table.combine_chunks().to_batches()[0], n_keys)
    return _voted(spread, _group_starts(spread, n_keys), n_keys, names)


def _group_starts(table: pa.Table, n_keys: int) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in range(n_keys):
        column = table.column(k).combine_chunks()
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(a.is_null(), b.is_null()))
        new[1:] |= np.array(differ, bool)
    return np.flatnonzero(new)


def _voted(table: pa.Table, starts: np.ndarray, n_keys: int, names: list[str]) -> pa.RecordBatch:
    """Rows in order of keys and ordinal (keys, seq, ord, and n if reads are counted) and where groups begin -> one row a group."""
    data, bounds, _ = flat(table.column(n_keys).combine_chunks())
    n, size = table.num_rows, np.diff(bounds)
    times = np.array(table["n"], np.int64) if "n" in table.column_names else np.ones(n, np.int64)
    group = np.searchsorted(starts, np.arange(n), "right") - 1
    width = np.maximum.reduceat(size, starts) if n else np.zeros(0, np.int64)
    first_cell = np.concatenate(([0], np.cumsum(width)))
    code = np.full(256, 4, np.uint8)
    code[list(b"ACGT")] = range(4)
    cells, cell = int(first_cell[-1]), np.repeat(first_cell[group] - bounds[:-1], size) + np.arange(len(data))
    # A fifth vote for letters that don't count.
    at = code[data] * np.int64(cells) + cell
    votes = np.bincount(at, np.repeat(times, size), 5 * cells).reshape(5, -1)[:4]
    best, most = np.zeros(cells, np.int64), votes[0].copy()
    for b in range(1, 4):
        more = votes[b] > most
        best[more] = b
        np.maximum(most, votes[b], out=most)
    # Ties go to the base whose first read comes first.
    tied = ((votes == most).sum(axis=0) > 1) & (most > 0)
    if tied.any():
        here = np.flatnonzero(tied[cell] & (at < 4 * cells))
        place = np.cumsum(tied) - 1
        seen = np.full((4, int(place[-1]) + 1), n, np.int64)
        # The first row that votes so is written last.
        seen[at[here][::-1] // cells, place[cell[here]][::-1]] = (np.searchsorted(bounds, here, "right") - 1)[::-1]
        best[tied] = np.where(votes[:, tied] == most[tied], seen, n).argmin(axis=0)
    called = column_of(np.frombuffer(b"ACGT", np.uint8)[best], first_cell, None, pa.string())
    at_start = pa.array(starts)
    total = np.bincount(group, times, len(starts)).astype(np.int64)
    return pa.RecordBatch.from_arrays([*[table.column(k).combine_chunks().take(at_start) for k in range(n_keys)], called, pa.array(total, pa.int64())], names=names)


def _consensus_by_rows(reads: DataFrame, keys: list[str], seq: str = "seq", order: str = "ord", only: str | None = "ACGT") -> DataFrame:
    """consensus() as aggregates with map-side combine: for groups too large for one task, and for any letters.

    Equal reads are counted once before positions are exploded, and a group of
    equal reads only is its own consensus, so clean copies are never exploded.
    """
    same = reads.groupBy(*keys, F.col(seq).alias("s")).agg(F.count("*").alias("n"), F.min(order).alias("o"))
    groups = same.groupBy(*keys).agg(F.count("*").alias("kinds"), F.sum("n").alias("n_reads"), F.min("s").alias("one"))
    alone = F.col("one") if only is None else F.regexp_replace("one", f"[^{only}]", "A")
    clean = groups.filter("kinds = 1").select(*keys, alone.alias(seq), "n_reads")
    mixed = same.join(groups.filter("kinds > 1").select(*keys, "n_reads"), keys)
    at = mixed.select(*keys, "n_reads", "n", "o", F.posexplode(F.split("s", "")).alias("pos", "base")).filter(F.col("base") != "")
    if only is not None:
        at = at.withColumn("base", F.when(F.instr(F.lit(only), F.col("base")) > 0, F.col("base")))
    votes = at.groupBy(*keys, "pos", "base").agg(F.sum("n").alias("n"), F.min("o").alias("o"), F.max("n_reads").alias("n_reads"))
    best = votes.groupBy(*keys, "pos").agg(F.min(F.when(F.col("base").isNotNull(), F.struct((-F.col("n")).alias("n"), F.col("o").alias("o"), F.col("base").alias("base")))).alias("b"), F.max("n_reads").alias("n_reads"))
    called = best.select(*keys, "pos", "n_reads", F.coalesce("b.base", F.lit("A")).alias("base"))
    parts = F.array_sort(F.collect_list(F.struct("pos", "base")))
    voted = called.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["base"]), "").alias(seq), F.max("n_reads").alias("n_reads"))
    return clean.unionByName(voted)


def modal_length(reads: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Reads of their group's most frequent length; ties go to the shorter."""
    n = reads.groupBy(*keys, F.char_length(seq).alias("len")).agg(F.count("*").alias("n"))
    best = n.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), "len"))["len"].alias("modal"))
    return reads.join(best, keys).filter(F.char_length(seq) == F.col("modal")).drop("modal")


def modal_ends(reads: DataFrame, keys: list[str], width: int, seq: str = "seq") -> DataFrame:
    """Most frequent prefix and suffix of a width per group; ties go to the lesser text. -> keys, left, right."""
    ends = reads.select(*keys, F.explode(F.array(F.struct(F.lit("left").alias("side"), F.left(F.col(seq), F.lit(width)).alias("end")), F.struct(F.lit("right").alias("side"), F.right(F.col(seq), F.lit(width)).alias("end")))).alias("x"))
    n = ends.groupBy(*keys, "x.side", "x.end").agg(F.count("*").alias("n"))
    best = n.groupBy(*keys).agg(
        F.min(F.when(F.col("side") == "left", F.struct((-F.col("n")).alias("n"), "end")))["end"].alias("left"),
        F.min(F.when(F.col("side") == "right", F.struct((-F.col("n")).alias("n"), "end")))["end"].alias("right"),
    )
    return best


def distinct_reads(reads: DataFrame, keys: list[str], seq: str = "seq", order: str = "ord") -> DataFrame:
    """Exact duplicates as one row: keys, seq, n, ord (first seen)."""
    return reads.groupBy(*keys, seq).agg(F.count("*").alias("n"), F.min(order).alias(order))


def multicopy(reads: DataFrame, keys: list[str], seq: str = "seq", order: str = "ord") -> DataFrame:
    """Distinct reads seen at least twice, or all where a group has none such."""
    one = distinct_reads(reads, keys, seq, order)
    most = one.groupBy(*keys).agg(F.max("n").alias("most"))
    return one.join(most, keys).filter((F.col("n") >= 2) | (F.col("most") < 2)).drop("most")


def estimated_originals(groups: DataFrame, keys: list[str]) -> DataFrame:
    """groups (keys, n) -> keys, originals: groups of at least max(2, total / 30) reads."""
    total = groups.groupBy(*keys).agg(F.sum("n").alias("total"))
    return groups.join(total, keys).groupBy(*keys).agg(F.count_if(F.col("n") >= F.greatest(F.lit(2.0), F.col("total") / 30)).alias("originals"))


def greedy_centres(groups: DataFrame, keys: list[str], n_centres: int, seq: str = "seq", order: str = "ord") -> DataFrame:
    """The n_centres most frequent distinct reads of each group, with rank from 1."""
    w = Window.partitionBy(*keys).orderBy(F.col("n").desc(), order)
    return groups.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n_centres)


def nearest_by_hamming(queries: DataFrame, centres: DataFrame, length: int, keys: list[str]) -> DataFrame:
    """queries (keys, qid, seq), centres (keys, rank, seq), of one length -> keys, qid, rank, distance; ties go to the lesser rank.

    Centres of a group are bounded by the top-k before. Distances are XORs of
    one-hot limbs.
    """
    q = queries.select(*keys, "qid", bits.limbs(F.col("seq"), length).alias("a"))
    c = centres.select(*keys, "rank", bits.limbs(F.col("seq"), length).alias("b"))
    pairs = q.join(c, keys) if keys else q.join(F.broadcast(c), F.lit(True))
    best = pairs.groupBy(*keys, "qid").agg(F.min(F.struct(bits.limb_distance(F.col("a"), F.col("b")).cast("int").alias("d"), "rank")).alias("best"))
    return best.select(*keys, "qid", F.col("best.rank").alias("rank"), F.col("best.d").alias("distance"))


def nearest_by_edits(queries: DataFrame, library: DataFrame) -> DataFrame:
    """queries (qid, seq), library (idx, oligo), a bounded dimension -> qid, idx, distance; ties go to the lesser idx."""
    return _nearest(queries, library, F.levenshtein("seq", "oligo"))


def _nearest(queries: DataFrame, library: DataFrame, distance: Column) -> DataFrame:
    """The library is checked to be small: every query meets all of it."""
    if not is_small(library):
        raise ValueError("the library is too large to compare every query with all of it")
    pairs = queries.join(F.broadcast(library), F.lit(True))
    best = pairs.groupBy("qid").agg(F.min(F.struct(distance.alias("d"), "idx")).alias("best"))
    return best.select("qid", F.col("best.idx").alias("idx"), F.col("best.d").alias("distance"))


def swap_distance(a: str, b: str) -> int:
    """Damerau-Levenshtein distance: edits and swaps of neighbours, each of which may be edited again."""
    far, last = len(a) + len(b), {}
    d = np.full((len(a) + 2, len(b) + 2), far)
    d[1:, 1], d[1, 1:] = range(len(a) + 1), range(len(b) + 1)
    for i, x in enumerate(a, 1):
        match = 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), match
            if x == y:
                match = j
            swap = d[k, m] + (i - k - 1) + 1 + (j - m - 1)
            d[i + 1, j + 1] = min(d[i, j] + (x != y), d[i + 1, j] + 1, d[i, j + 1] + 1, swap)
        last[x] = i
    return int(d[-1, -1])


def nearest_by_swaps(queries: DataFrame, library: DataFrame) -> DataFrame:
    """As nearest_by_edits with swaps of neighbours as one edit."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for xs, ys in batches:
            yield pa.array([swap_distance(x, y) for x, y in zip(xs.to_pylist(), ys.to_pylist(), strict=True)], pa.int32())

    return _nearest(queries, library, F.arrow_udf(run, "int")("seq", "oligo"))


def length_stats(reads: DataFrame, seq: str = "seq") -> DataFrame:
    """n, total, mean, least and most length."""
    n = F.char_length(seq)
    return reads.agg(F.count("*").alias("n"), F.sum(n).alias("total"), F.avg(n).alias("mean"), F.min(n).alias("least"), F.max(n).alias("most"))


def top_per_position(values: DataFrame, n: int) -> DataFrame:
    """values (pos, value, ord) -> pos, value, n, rank: the n most used values of each position; ties go to the first seen."""
    counts = values.groupBy("pos", "value").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    w = Window.partitionBy("pos").orderBy(F.col("n").desc(), "first")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).drop("first")
