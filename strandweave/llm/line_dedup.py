"""Line deduplication by a sorted stream of hashes, with compressed per-document keep bitmaps.

Lines become (key hash, document, position) rows. Rows of frequent keys are
range-partitioned by hash and sorted by document, largest first, and position;
a running window over that order streams the first document of each key, which
keeps its lines. A key of very many documents is streamed in parts, whose heads
are merged. What travels back are sparse bitmaps of kept positions, not text:
texts of documents that surely lose no line never move. DataFrame functions only.

A key is two seeded 64-bit hashes of the line; that any two of 1e12 different
lines agree in both has a chance of about 1e-15.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import let
from .common import added_names, fresh, materialise, maybe_broadcast

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS = 40
MIN_DOCS = 5
#: Documents of a key that one part streams about.
RUN = 1_000
#: Bits of the sieve for each document that loses lines, and bits at most: 32 MB is what its broadcast takes at any size.
SIEVE_BITS, SIEVE_MOST = 16, 1 << 28
#: A word of 64 kept lines.
WHOLE = -1


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _keys(text: Column) -> Column:
    """Per line, its key: stripped of white space at both ends, A-Z lower-cased."""
    return F.transform(lines_of(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)), lambda x: F.btrim(x, F.lit(WHITE)))


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def frequent_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, run: int = RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a, b, doc_id, text_hash, pos of each line whose key has min_chars code points and is in min_docs documents, with part and parts: which part of its key streams it."""
    hashed = F.transform(_keys(F.col(text_col)), lambda k: F.when(F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(min_chars), k).alias("b"))))
    rows = docs.select(F.col(id_col).alias("doc_id"), _text_hash(F.col(text_col)).alias("text_hash"), hashed.alias("h"))
    once = rows.select(F.explode(F.array_distinct(F.filter("h", lambda x: x.isNotNull()))).alias("k"))
    counts = once.groupBy("k.a", "k.b").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs)
    counts = materialise(counts.select("a", "b", F.ceil(F.col("n") / run).cast("int").alias("parts")), "frequent-lines")
    each = rows.select("doc_id", "text_hash", F.posexplode("h").alias("pos", "k")).filter(F.col("k").isNotNull()).select("doc_id", "text_hash", "pos", "k.a", "k.b")
    return materialise(each.join(maybe_broadcast(counts), ["a", "b"]).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")), "frequent-rows")


def streamed_heads(rows: DataFrame) -> DataFrame:
    """rows of frequent_lines with head, the first document of their run in order, and starts, whether the row begins the run.

    The window streams over the partitions and the order that are there: its
    plan has no other exchange or sort.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("pos")]
    dealt = rows.repartitionByRange("a", "b", "part").sortWithinPartitions("a", "b", "part", *order)
    run = Window.partitionBy("a", "b", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dealt.withColumn("head", F.first("doc_id").over(run)).withColumn("starts", F.count("*").over(run) == 1)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, run: int = RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document that loses lines: doc_id, text_hash, keep: sorted (w, bits) of 64 lines each, a bit set for each kept line; words not listed are kept whole.

    Keys of at least min_chars code points found in at least min_docs documents
    lose all lines except in the largest doc_id holding the key. Sorting,
    streaming and bitmaps are linear in the lines.
    """
    rows = materialise(streamed_heads(frequent_lines(docs, min_chars, min_docs, run, id_col, text_col)), "streamed-lines")
    heads = rows.filter(F.col("starts") & (F.col("parts") > 1)).groupBy("a", "b").agg(F.max("head").alias("first"))
    heads = maybe_broadcast(materialise(heads.filter(F.col("first").isNotNull()), "line-heads"))
    holder = F.coalesce("first", "head")
    lost = rows.join(heads, ["a", "b"], "left").filter(holder.isNotNull() & ~F.col("doc_id").eqNullSafe(holder))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % 64)
    words = lost.groupBy("doc_id", "text_hash", F.shiftright("pos", 6).alias("w")).agg(F.bit_or(bit).alias("gone"))
    return words.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("w", F.bitwise_not("gone").alias("bits")))).alias("keep"))


def _dense(keep: Column) -> Column:
    """Sparse words as an array by word, up to the last one listed."""
    before = lambda i: F.coalesce(F.get(keep, i - 1)["w"], F.lit(-1))
    return F.flatten(F.transform(keep, lambda e, i: F.concat(F.array_repeat(F.lit(WHOLE).cast("long"), e["w"] - before(i) - 1), F.array(e["bits"]))))


def kept_text(text: Column, keep: Column) -> Column:
    kept = lambda d: lambda x, i: F.getbit(F.coalesce(F.get(d, F.shiftright(i, 6)), F.lit(WHOLE).cast("long")), i % 64) == 1
    return let(_dense(keep), lambda d: F.array_join(F.filter(lines_of(text), kept(d)), "\n"))


def _sieve(bitmaps: DataFrame, bits: int) -> DataFrame:
    """A hashed bit set of the documents in bitmaps, in pages: page, mask."""
    at = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(bits))
    return bitmaps.select(at.alias("x")).groupBy(F.bitmap_bucket_number("x").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("mask"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, run: int = RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text replaced by its kept lines, plus n_lines and n_dropped (renamed if such columns exist).

    Null or empty text is one empty line and stays as it is (null becomes
    empty). Each row is a document: repeated rows count as several. A null id
    is below all others; a key held by null ids only keeps its lines. An empty
    table gives an empty result. Extra columns are kept. A very long text is
    one row; splitting it and testing its lines is linear.

    The plan is the same at every size: a sieve of bounded size tells on the
    map side which documents may lose lines, and only their texts meet the
    bitmaps in a sort-merge join.
    """
    th, bi, bh, bm, x, page, mask = (fresh(docs, s) for s in ("th", "bi", "bh", "bm", "x", "page", "mask"))
    bitmaps = materialise(keep_bitmaps(docs, min_chars, min_docs, run, id_col, text_col), "line-bitmaps")
    bits = min(SIEVE_MOST, 1 << max(20, (SIEVE_BITS * bitmaps.count()).bit_length()))
    sieve = _sieve(bitmaps, bits).select(F.col("page").alias(page), F.col("mask").alias(mask))
    keyed = docs.withColumn(th, _text_hash(F.col(text_col))).withColumn(x, F.pmod(F.xxhash64(F.col(id_col), F.col(th)), F.lit(bits)))
    sifted = keyed.join(F.broadcast(sieve), F.bitmap_bucket_number(x) == F.col(page), "left")
    place = F.bitmap_bit_position(x)
    byte = F.conv(F.hex(F.substring(F.col(mask), F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    of = bitmaps.select(F.col("doc_id").alias(bi), F.col("text_hash").alias(bh), F.col("keep").alias(bm))
    n_lines, n_dropped = added_names(docs, "n_lines", "n_dropped")
    text = F.coalesce(F.col(text_col), F.lit(""))

    def result(df: DataFrame, kept: Column, dropped: Column) -> DataFrame:
        lines = F.regexp_count(text, F.lit("\n")).cast("long") + 1
        return df.select(*[(kept.alias(c) if c == text_col else F.col(f"`{c}`")) for c in docs.columns], lines.alias(n_lines), dropped.alias(n_dropped))

    whole = result(sifted.filter(~may), text, F.lit(0).cast("long"))
    met = sifted.filter(may).join(of.hint("merge"), F.col(id_col).eqNullSafe(F.col(bi)) & (F.col(th) == F.col(bh)), "left")
    dropped = F.aggregate(F.coalesce(F.transform(bm, lambda e: 64 - F.bit_count(e["bits"])), F.array().cast("array<int>")), F.lit(0).cast("long"), lambda acc, n: acc + n)
    return whole.unionByName(result(met, F.when(F.col(bm).isNull(), text).otherwise(kept_text(F.col(text_col), F.col(bm))), dropped))
