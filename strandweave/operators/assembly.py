"""Libraries of motifs, oligos and pools."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nt, rng
from ..scratch import maybe_broadcast, numbered


def linear_motifs(library: DataFrame) -> DataFrame:
    """library (oligo) -> motif, symbol: halves paired with their complements, numbered in order, the complement with a *.

    A pair's named motif is the lesser of the two; names are a1, a1*, a2, ...
    """
    k = (F.char_length("oligo") / 2).cast("int")
    halves = library.select(F.explode(F.array(F.left(F.col("oligo"), k), F.substring(F.col("oligo"), k + 1, k))).alias("half")).distinct()
    named = halves.select(nt.canonical(F.col("half")).alias("motif")).distinct()
    ranks = numbered(named, "rank", F.col("motif"), start=1)
    one = ranks.select("motif", F.concat(F.lit("a"), F.col("rank").cast("string")).alias("symbol"))
    return one.unionByName(one.select(nt.reverse_complement(F.col("motif")).alias("motif"), F.concat("symbol", F.lit("*")).alias("symbol")).join(one.select("motif"), "motif", "left_anti"))


def translate_oligos(library: DataFrame, motifs: DataFrame) -> DataFrame:
    """library (idx, oligo) -> idx, oligo, left_symbol, right_symbol, by a dimension of motifs, broadcast if it is small."""
    k = (F.char_length("oligo") / 2).cast("int")
    a, b = motifs.select(F.col("motif").alias("l"), F.col("symbol").alias("left_symbol")), motifs.select(F.col("motif").alias("r"), F.col("symbol").alias("right_symbol"))
    halves = library.withColumn("l", F.left(F.col("oligo"), k)).withColumn("r", F.substring(F.col("oligo"), k + 1, k))
    return halves.join(maybe_broadcast(a), "l", "left").join(maybe_broadcast(b), "r", "left").select("idx", "oligo", "left_symbol", "right_symbol")


def back_translate(symbols: Column, motifs: dict[str, str]) -> Column:
    """An array of symbols as one strand; unknown symbols give null."""
    table = F.create_map(*[F.lit(x) for kv in motifs.items() for x in kv])
    return F.aggregate(F.transform(symbols, lambda s: F.try_element_at(table, s)), F.lit(""), lambda a, x: F.concat(a, x))


def positional_motifs(sections: DataFrame) -> DataFrame:
    """sections (section, idx, seq) -> section, idx, seq, sym, sym_rc: left and right message halves, generics, connectors."""
    k = (F.char_length("seq") / 2).cast("int")
    both = F.when(F.col("section") == "Messages", F.array(F.struct(F.lit("ml").alias("p"), F.left(F.col("seq"), k).alias("s")), F.struct(F.lit("mr").alias("p"), F.substring(F.col("seq"), k + 1, k).alias("s")))).otherwise(
        F.array(F.struct(F.when(F.col("section") == "Generic", "g").otherwise("c").alias("p"), F.col("seq").alias("s")))
    )
    return sections.select("section", "idx", F.explode(both).alias("x")).select("section", "idx", F.col("x.s").alias("seq"), F.concat("x.p", F.col("idx").cast("string")).alias("sym"), F.concat(F.concat("x.p", F.col("idx").cast("string")), F.lit("*")).alias("sym_rc"))


def oriented(fwd: Column, rev: Column, marker: str) -> Column:
    """struct(five, three): the duplex turned so that the marker begins its first strand, where an end has it."""
    swap = (F.get(rev, F.lit(0)) == marker) | (F.element_at(rev, -1) == marker)
    five, three = F.when(swap, rev).otherwise(fwd), F.when(swap, fwd).otherwise(rev)
    turn = F.get(five, F.lit(0)) != marker
    return F.struct(F.when(turn, F.reverse(five)).otherwise(five).alias("five"), F.when(turn, F.reverse(three)).otherwise(three).alias("three"))


def back_translate_pool(pools: DataFrame, motifs: dict[str, str], marker: str, marked_only: bool = True, silent: bool = False) -> DataFrame:
    """pools (..., fwd, rev) -> ..., five_prime, three_prime: both strands of each oligo as bases, the marker's end first.

    Places where a strand is single ('') add nothing. marked_only drops oligos
    with the marker at no end, as a real pool has them. A silent marker stands
    for no bases.
    """
    at_end = F.lit(False)
    for side in ("fwd", "rev"):
        at_end = at_end | (F.get(side, F.lit(0)) == marker) | (F.element_at(side, -1) == marker)
    rows = pools.filter(at_end) if marked_only else pools
    says = lambda c: back_translate(F.filter(c, lambda s: (s != "") & (s != marker if silent else F.lit(True))), motifs)
    rest = [F.col(f"`{c}`") for c in pools.columns if c not in ("fwd", "rev")]
    turned = rows.select(*rest, oriented(F.col("fwd"), F.col("rev"), marker).alias("o"))
    return turned.select(*rest, says(F.col("o.five")).alias("five_prime"), says(F.col("o.three")).alias("three_prime"))


def positional_libraries(library: DataFrame, positions: int) -> DataFrame:
    """library (idx, oligo) -> position, idx, oligo: for each position of a codeword the oligos that may stand there.

    Left and right halves are listed in order. Position i excludes oligos with
    left half number i // 2 or right half number (i + 1) // 2 anywhere, or with
    the reverse complement of either, so neighbours don't join elsewhere.
    """
    k = (F.char_length("oligo") / 2).cast("int")
    need = positions // 2 + 1
    first = lambda half: [r[0] for r in library.select(half.alias("h")).distinct().orderBy("h").limit(need).collect()]
    left, right = first(F.left(F.col("oligo"), k)), first(F.substring(F.col("oligo"), k + 1, k))
    if min(len(left), len(right)) < need:
        raise ValueError("the library has too few motifs for so many positions")
    bars = [F.struct(F.lit(i).alias("position"), F.array(F.lit(left[i // 2]), F.lit(right[(i + 1) // 2])).alias("motifs")) for i in range(positions)]
    at = library.select("idx", "oligo", F.explode(F.array(*bars)).alias("b"))
    barred = F.exists("b.motifs", lambda m: F.contains(F.col("oligo"), m) | F.contains(F.col("oligo"), nt.reverse_complement(m)))
    return at.filter(~barred).select("b.position", "idx", "oligo")


def excluded(library: DataFrame, used: DataFrame) -> DataFrame:
    """Oligos that contain none of the used motifs (motif): an anti join on k-mers of the motifs' lengths."""
    sizes = [r[0] for r in used.select(F.char_length("motif")).distinct().collect()]
    left = library
    for k in sizes:
        at = library.select("idx", F.explode(nt.kmers(F.col("oligo"), k)).alias("motif"))
        left = left.join(at.join(maybe_broadcast(used), "motif", "left_semi").select("idx").distinct(), "idx", "left_anti")
    return left


def mirror(fwd: Column, rev: Column) -> Column:
    """An oligo read from its other end."""
    return F.struct(F.reverse(rev).alias("fwd"), F.reverse(fwd).alias("rev"))


def pool(oligos: DataFrame, mean: float, std: float, seed: int = 0) -> DataFrame:
    """oligos (oligo_id, fwd, rev) with n, their copies: max(0, int(N(mean, std)))."""
    n = F.greatest(F.lit(0), (F.lit(float(mean)) + F.lit(float(std)) * rng.normal(seed, "pool", F.col("oligo_id"))).cast("int"))
    return oligos.withColumn("n", n.cast("long"))


def merge_pools(*pools: DataFrame) -> DataFrame:
    out = pools[0]
    for p in pools[1:]:
        out = out.unionByName(p)
    return out.groupBy("fwd", "rev").agg(F.sum("n").alias("n"))


def histogram(pooled: DataFrame) -> DataFrame:
    """Copies of each oligo, an oligo and its mirror image being one: key, n."""
    own = F.array_join(F.concat("fwd", F.lit(["/"]), "rev"), ",")
    other = F.array_join(F.concat(F.reverse("rev"), F.lit(["/"]), F.reverse("fwd")), ",")
    return pooled.groupBy(F.least(own, other).alias("key")).agg(F.sum("n").alias("n"))


Oligo = tuple[tuple[str, ...], tuple[str, ...]]


def complement_symbol(s: str) -> str:
    return s[:-1] if s.endswith("*") else s + "*"


def pair(a: Oligo, b: Oligo) -> Oligo | None:
    """Join two oligos where a free end of one complements a free end of the other, in any of their orientations.

    fwd and rev are symbols of the two strands by place, '' where a strand is
    single. The right end of one has a free forward symbol and the left end of
    the other a free reverse symbol that complements it.
    """
    flip = lambda o: (tuple(reversed(o[1])), tuple(reversed(o[0])))
    for x, y in ((a, b), (b, a)):
        for p in (x, flip(x)):
            for q in (y, flip(y)):
                if p[0][-1] and not p[1][-1] and q[1][0] and not q[0][0] and q[1][0] == complement_symbol(p[0][-1]):
                    return p[0] + q[0][1:], p[1][:-1] + q[1]
                if p[1][-1] and not p[0][-1] and q[0][0] and not q[1][0] and q[0][0] == complement_symbol(p[1][-1]):
                    return p[0][:-1] + q[0], p[1] + q[1][1:]
    return None


def hybridise(pools: DataFrame, steps: int | None = None, seed: int = 0) -> DataFrame:
    """pools (pool_id, fwd, rev, n) -> pool_id, fwd, rev, n after `steps` random meetings; sequential within a pool.

    Without steps a pool has ten meetings for each oligo that it begins with.
    """

    def run(key, table):
        r = random.Random(f"{seed}|{key[0].as_py()}")
        rows = sorted((tuple(x["fwd"]), tuple(x["rev"])) for x in table.to_pylist() for _ in range(x["n"]))
        for _ in range(10 * len(rows) if steps is None else steps):
            if len(rows) < 2:
                break
            i, j = r.sample(range(len(rows)), 2)
            made = pair(rows[i], rows[j])
            if made:
                for k in sorted((i, j), reverse=True):
                    rows[k] = rows[-1]
                    rows.pop()
                rows.append(made)
        counts: dict[Oligo, int] = {}
        for o in rows:
            counts[o] = counts.get(o, 0) + 1
        strings = pa.list_(pa.string())
        return pa.table({"pool_id": pa.array([key[0].as_py()] * len(counts), pa.int64()), "fwd": pa.array([list(o[0]) for o in counts], strings), "rev": pa.array([list(o[1]) for o in counts], strings), "n": pa.array(list(counts.values()), pa.int64())})

    return pools.groupBy("pool_id").applyInArrow(run, "pool_id long, fwd array<string>, rev array<string>, n long")


def generate_library(spark: SparkSession, size: int, length: int, apart: int, seed: int = 0) -> DataFrame:
    """idx, oligo: seeded random oligos at least `apart` edits from each other, by rejection."""
    from .gcplus import edit_distances

    g = np.random.Generator(np.random.PCG64(seed))
    found, book = [], np.zeros((0, length), np.uint8)
    for _ in range(10_000 * size):
        if len(found) == size:
            break
        w = "".join("ACGT"[i] for i in g.integers(0, 4, length))
        if not len(book) or edit_distances(w, book).min() >= apart:
            found.append(w)
            book = np.vstack((book, np.frombuffer(w.encode(), np.uint8)[None, :]))
    return spark.createDataFrame(list(enumerate(found)), "idx int, oligo string")
