"""MinHash near-deduplication: one permutation, optimal densification, bands, stars.

A document's set of 5-word shingles is hashed once; the top bits of a hash are
its bin, the least hash of a bin its signature value. An empty bin takes the
value of the first non-empty bin in an order of its own. Bands of values are
buckets. Equal sets are one node. In each bucket every member is compared with
the bucket's hub only (a star). Where that leaves a bucket in several classes,
the members outside the hub's class meet the others of like size in blocks of
bounded rows: first by signatures of 512 bytes, then, for members that have a
candidate there, by their full sets. A pair that shares a bucket is compared
unless it is already connected, so no link is lost, and no pair is a row. Links
are confirmed on full sets of 64-bit shingle hashes; that two different
shingles of two documents of 1,000 words agree has a chance of 1e-13.

With 32 bands of 4 values a pair of similarity 0.75 shares no bucket with
probability (1 - 0.75**4)**32 = 5e-6, one of 0.8 with 5e-8.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise, maybe_broadcast, release
from .components import components
from .textkernel import mix, shingle_sets, slices

BINS, ROWS = 128, 4
BANDS = BINS // ROWS
#: Percent of similarity from which documents link.
PERCENT = 75
#: Members compared with one copy of a hub's text in one task.
STAR = 256
#: Members of a block, by signatures; shingles of a block, by full sets: what a task holds of each side.
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000
#: Bins of BINS in which the signatures of a candidate pair agree at least. A pair of similarity 0.75 agrees in 96 on average, in fewer than 56 with a chance of 2e-13.
AGREE = 56
#: Ids that may be broadcast to pick candidate texts.
PICK_ROWS = 300_000

_rng = np.random.Generator(np.random.PCG64(5150))
_ORDER = np.argsort(_rng.random((BINS, BINS)), axis=1).argsort(axis=1).astype(np.int16)
_MULT = _rng.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_EDGES = (np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1))
SIGNATURE = "struct<n_shingles:bigint,digest:binary,bands:array<bigint>,sketch:binary>"


def signature(hashes: np.ndarray) -> np.ndarray:
    """Densified one-permutation values of a sorted, non-empty set."""
    at = np.searchsorted(hashes, _EDGES)
    full = np.append(at[1:], len(hashes)) > at
    values = hashes[np.minimum(at, len(hashes) - 1)]
    if not full.all():
        have, lack = np.flatnonzero(full), np.flatnonzero(~full)
        values[lack] = values[have[_ORDER[np.ix_(lack, have)].argmin(axis=1)]]
    return values


def bands_of(values: np.ndarray) -> np.ndarray:
    return mix((values.reshape(BANDS, ROWS) * _MULT).sum(axis=1, dtype=np.uint64)).view(np.int64)


def sketch_of(values: np.ndarray) -> np.ndarray:
    """32 bits of each signature value."""
    return (mix(values) >> np.uint64(32)).astype("<u4")


def _signed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in texts:
        n, digests, bands, sketches = [], [], [], []
        for t in slices(column):
            for s in shingle_sets(t):
                values = signature(s) if len(s) else None
                n.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                bands.append(bands_of(values) if len(s) else np.zeros(0, np.int64))
                sketches.append(sketch_of(values).tobytes() if len(s) else None)
        ends = np.concatenate(([0], np.cumsum([len(b) for b in bands]))).astype(np.int32)
        flat = pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64), pa.int64())
        yield pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), flat), pa.array(sketches, pa.binary())], names=["n_shingles", "digest", "bands", "sketch"]
        )


def signed(text: Column) -> Column:
    return F.arrow_udf(_signed, SIGNATURE)(text)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, salt, b, text) in order of (a, salt), hub rows (b null) first -> a, b, linked."""
    now, hubs = None, {}
    for batch in batches:
        a, salt, b = (batch.column(i).to_pylist() for i in range(3))
        left, right, linked = [], [], []
        for t in slices(batch.column(3)):
            for i, s in enumerate(shingle_sets(t), t.first):
                if (a[i], salt[i]) != now:
                    now, hubs = (a[i], salt[i]), {}
                if b[i] is None:
                    hubs[hashlib.blake2b(s.tobytes(), digest_size=16).digest()] = s  # rows that repeat the hub count once
                    continue
                left.append(a[i])
                right.append(b[i])
                linked.append(any(_similar(h, s) for h in hubs.values()))
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64()), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])


def _similar(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate((x, y))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def compare(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b) distinct, texts (doc_id, text) -> a, b, linked, confirmed on full shingle sets.

    A hub's members meet one copy of its text for each STAR of them, so a hub
    of very many members is dealt over many tasks. Texts are streamed.
    """
    pairs = materialise(pairs, "pairs")
    n = pairs.count()
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = texts.filter(F.col("doc_id").isNotNull()).join(F.broadcast(ids) if 2 * n <= PICK_ROWS else ids, "doc_id", "left_semi")
    hot = maybe_broadcast(materialise(pairs.groupBy(F.col("a").alias("h")).agg(F.count("*").alias("n")).filter(F.col("n") > STAR), "hot-hubs"))
    salted = pairs.join(hot, F.col("a") == F.col("h"), "left").select(
        "a", "b", F.pmod(F.xxhash64("b"), F.coalesce(F.ceil(F.col("n") / STAR), F.lit(1))).cast("int").alias("salt")
    )
    few = (lambda x: F.broadcast(x)) if n <= PICK_ROWS else (lambda x: x)
    members = texts.join(few(salted), F.col("doc_id") == F.col("b")).select("a", "salt", "b", "text")
    hubs = texts.join(few(salted.select("a", "salt").distinct()), F.col("doc_id") == F.col("a")).select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    dealt = members.unionByName(hubs).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return materialise(dealt.mapInArrow(_compared, "a long, b long, linked boolean").groupBy("a", "b").agg(F.max("linked").alias("linked")), "compared")


def _alike(x: Column, y: Column) -> Column:
    """Sizes that leave the similarity possible."""
    return (100 * x >= PERCENT * y) & (100 * y >= PERCENT * x)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id (whole numbers), n_shingles, component_id, kept.

    A null or empty text, or one without words, has an empty set, links with
    nothing and stays. Fewer than five words: the whole sequence is the one
    shingle. Rows that repeat an id each go by their own text; texts that no
    lesser id has are one node under it. A null id is never a class's id: such rows go with a named document of equal
    shingles, else stay by themselves with a null class. An empty table gives an
    empty result. Other columns are ignored. A very long text is one row: its
    set is made in memory of a few times its size.
    """
    return _decided(docs, id_col, text_col)


def _decided(docs: DataFrame, id_col: str, text_col: str, *carried: Column) -> DataFrame:
    """near_duplicates with columns of each row (of doc_id and text) carried along."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    extra = texts.select(*carried).columns if carried else []
    rows = materialise(texts.select("doc_id", *carried, signed(F.col("text")).alias("s")).select("doc_id", *extra, "s.*"), "signatures")
    nodes = rows.filter(F.col("n_shingles") > 0).groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
    )
    nodes = materialise(nodes.filter(F.col("rep").isNotNull()), "nodes")
    banded = nodes.select("rep", "n", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("k"), F.min(F.struct("rep", "n")).alias("hub")).filter("k > 1").select(F.col("key").alias("x"), "hub")
    members = materialise(banded.join(shared, F.col("key") == F.col("x")).select("key", "rep", "n", "hub"), "members")
    pairs = members.filter((F.col("rep") != F.col("hub.rep")) & _alike(F.col("n"), F.col("hub.n"))).select(F.col("hub.rep").alias("a"), F.col("rep").alias("b")).distinct()
    done = compare(pairs, texts)
    links = done.filter("linked").select("a", "b")
    labels = components(links)
    more = compare_blocks(_undecided(members, labels), nodes.select(F.col("rep").alias("id"), "sketch"), texts)
    if not more.isEmpty():
        labels = components(labels.select(F.col("label").alias("a"), F.col("node").alias("b")).unionByName(more))
    classes = (
        nodes.join(labels, F.col("rep") == F.col("node"), "left")
        .filter((F.col("copies") > 1) | F.col("label").isNotNull())
        .select(F.col("digest").alias("d"), F.coalesce("label", "rep").alias("class"))
    )
    classes = materialise(classes, "classes")
    # Rows without words have no digest; kept out of the join, they can't meet in one task.
    named = rows.filter(F.col("digest").isNotNull()).join(maybe_broadcast(classes), F.col("digest") == F.col("d"), "left").select("doc_id", "n_shingles", "class", *extra)
    empty = rows.filter(F.col("digest").isNull()).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("class"), *extra)
    both = named.unionByName(empty).withColumn("component_id", F.coalesce("class", "doc_id"))
    return both.select("doc_id", F.col("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), *extra)


def _undecided(members: DataFrame, labels: DataFrame) -> DataFrame:
    """hub, id, n, label, outside: members of buckets where two that aren't the hub are in different classes.

    The hub itself has been compared with all. outside: in another class than
    the hub. A hub's buckets make one group.
    """
    named = members.select("key", "rep", "n", F.col("hub.rep").alias("hub")).join(labels, F.col("rep") == F.col("node"), "left").withColumn("label", F.coalesce("label", "rep")).drop("node")
    own = F.max(F.when(F.col("rep") == F.col("hub"), F.col("label")))
    rest = F.when(F.col("rep") != F.col("hub"), F.col("label"))
    named = materialise(named, "labelled")
    mixed = named.groupBy("key").agg(F.min(rest).alias("lo"), F.max(rest).alias("hi"), own.alias("own")).filter("lo <> hi").select(F.col("key").alias("x"), "own")
    rows = named.filter(F.col("rep") != F.col("hub")).join(mixed, F.col("key") == F.col("x"))
    return materialise(rows.groupBy("hub", F.col("rep").alias("id"), "n").agg(F.first("label").alias("label"), F.first(F.col("label") != F.col("own")).alias("outside")), "undecided")


def compare_blocks(groups: DataFrame, sketches: DataFrame, texts: DataFrame) -> DataFrame:
    """groups (hub, id, n, label, outside), sketches (id, sketch), texts -> a, b: links between members of one group in different classes.

    Members outside the hub's class meet all members of like size. Both sides
    are dealt by hash into blocks of at most about BLOCK members, and a task
    holds one block of each; what travels are signatures. Members with a
    candidate in a tile then meet there again with their full sets, dealt into
    blocks of bounded shingles. No pair is a row: a first tile gives at most its
    members, a second at most a star.
    """
    sized = groups.withColumn("z", F.floor(F.log("n") / (1.000001 * math.log(100 / PERCENT))).cast("int"))
    near_sizes = F.explode(F.array(*[F.col("z") + d for d in (-1, 0, 1)]))
    outer = sized.filter("outside").select("hub", "z", F.lit(0).alias("role"), "id", "label", "n")
    inner = sized.select("hub", near_sizes.alias("z"), F.lit(1).alias("role"), "id", "label", "n")
    tiles = materialise(_dealt(outer, inner, ["hub", "z"], F.lit(1), BLOCK), "blocks")
    full = tiles.join(sketches, "id").select("hub", "z", "i", "j", "role", "id", "label", "n", "sketch")
    full = full.repartition("hub", "z", "i", "j").sortWithinPartitions("hub", "z", "i", "j", "role", "id")
    found = materialise(full.mapInArrow(_candidates, "hub long, z int, i int, j int, role int, id long, label long, n long"), "candidates")
    release(tiles)
    keys = ["hub", "z", "i", "j"]
    again = materialise(_dealt(found.filter("role = 0"), found.filter("role = 1"), keys, F.col("n"), BLOCK_SHINGLES, "i2", "j2"), "candidate-blocks")
    sets = _sets(again.select("id").distinct(), texts)
    keys += ["i2", "j2"]
    full = again.join(sets, "id").select(*keys, "role", "id", "label", "shingles").repartition(*keys).sortWithinPartitions(*keys, "role", "id")
    return materialise(full.mapInArrow(_tile_links, "a long, b long").distinct(), "block-links")


def _dealt(outer: DataFrame, inner: DataFrame, keys: list[str], weight: Column, most: int, i: str = "i", j: str = "j") -> DataFrame:
    """Rows of both sides (keys, role, id, label, n) in tiles (i, j) of the keys they share; a block weighs about `most`."""
    blocks = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.sum(weight) / most).cast("int").alias(name))
    total = materialise(blocks(outer, "p").join(blocks(inner, "q"), keys), "block-counts")
    block = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = ["role", "id", "label", "n"]
    few = maybe_broadcast(total)
    left = outer.join(few, keys).select(*keys, block(1, "p").alias(i), upto("q").alias(j), *rest)
    right = inner.join(few, keys).select(*keys, upto("p").alias(i), block(2, "q").alias(j), *rest)
    return left.unionByName(right)


def _sets(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """id, shingles: the hashed sets of the documents with these ids, one row for each different text."""

    def hashed(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([s.tobytes() for t in slices(column) for s in shingle_sets(t)], pa.binary())

    ids = materialise(ids, "candidate-ids")
    wanted = texts.filter(F.col("doc_id").isNotNull()).join(maybe_broadcast(ids, PICK_ROWS), F.col("doc_id") == F.col("id"), "left_semi")
    return wanted.select(F.col("doc_id").alias("id"), F.arrow_udf(hashed, "binary")("text").alias("shingles")).distinct()


def _tiles(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[list[tuple]]]]:
    """Rows in order of their first n_keys columns, with role 0 or 1 next -> per tile its key and the other columns of both sides."""
    now: tuple | None = None
    sides: list[list[tuple]] = [[], []]
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[:n_keys] != now:
                if now is not None:
                    yield now, sides
                now, sides = row[:n_keys], [[], []]
            sides[row[n_keys]].append(row[n_keys + 1 :])
    if now is not None:
        yield now, sides


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles (hub, z, i, j; role; id, label, n, sketch) -> their rows that have a candidate on the other side, without sketches."""
    names = ["hub", "z", "i", "j", "role", "id", "label", "n"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    for key, sides in _tiles(batches, 4):
        if not all(sides):
            continue
        x, y = (np.frombuffer(b"".join(r[3] for r in side), "<u4").reshape(len(side), BINS) for side in sides)
        agree = np.zeros((len(x), len(y)), np.uint8)
        for k in range(BINS):
            agree += x[:, k, None] == y[None, :, k]
        may = (agree >= AGREE) & _apart(sides)
        rows = [(*key, role, *r[:3]) for role, side in enumerate(sides) for r, hit in zip(side, may.any(axis=1 - role), strict=True) if hit]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=names)


def _apart(sides: list[list[tuple]]) -> np.ndarray:
    """Which pairs (id, label, ...) are in different classes."""
    return np.array([r[1] for r in sides[0]])[:, None] != np.array([r[1] for r in sides[1]])[None, :]


def _tile_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles (hub, z, i, j, i2, j2; role; id, label, set) -> star edges of what links connect within each."""
    for _, sides in _tiles(batches, 6):
        if not all(sides):
            continue
        sets = [[np.frombuffer(r[2], np.uint64) for r in side] for side in sides]
        linked = _similar_matrix(*sets) & _apart(sides)
        rows = _stars([r[0] for r in sides[0]], [r[0] for r in sides[1]], linked)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["a", "b"])


def _stars(outer: list[int], inner: list[int], linked: np.ndarray) -> list[tuple[int, int]]:
    """(root, member) of what links connect."""
    a, b, most = np.array(outer, np.int64), np.array(inner, np.int64), np.iinfo(np.int64).max
    la, lb = a.copy(), b.copy()
    while linked.any():
        na = np.minimum(la, np.where(linked, lb[None, :], most).min(axis=1))
        nb = np.minimum(lb, np.where(linked, na[:, None], most).min(axis=0))
        if (na == la).all() and (nb == lb).all():
            break
        la, lb = na, nb
    return sorted({(int(r), int(x)) for r, x in zip(np.append(la, lb), np.append(a, b), strict=True) if r != x})


def _similar_matrix(x: list[np.ndarray], y: list[np.ndarray], percent: int = PERCENT, width: int = 4096) -> np.ndarray:
    """Which sets of x and y are similar: sizes of intersections as products of incidence matrices, some columns at a time."""
    shared = np.intersect1d(np.concatenate(x), np.concatenate(y))
    common = np.zeros((len(x), len(y)), np.float32)

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(shared, flat), max(len(shared) - 1, 0))
        ok = shared[at] == flat
        order = np.argsort(at[ok], kind="stable")
        return row[ok][order], at[ok][order]

    if len(shared):
        (rx, cx), (ry, cy) = places(x), places(y)
        for lo in range(0, len(shared), width):
            part = []
            for n, row, col in ((len(x), rx, cx), (len(y), ry, cy)):
                a, b = np.searchsorted(col, (lo, lo + width))
                m = np.zeros((n, min(width, len(shared) - lo)), np.float32)
                m[row[a:b], col[a:b] - lo] = 1
                part.append(m)
            common += part[0] @ part[1].T
    nx, ny = (np.array([len(s) for s in side], np.float32) for side in (x, y))
    return (common > 0) & (100 * common >= percent * (nx[:, None] + ny[None, :] - common))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay when one document of each class does; columns unchanged.

    Decided for each row, by id and text: of rows that share an id, or have
    none, only those whose text isn't kept go. Null, empty and very long texts,
    ties and empty tables as in near_duplicates; rows that repeat a kept id and
    text all stay.
    """
    gone, lost_text = fresh(docs, "gone"), fresh(docs, "lost_text")
    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    lost = _decided(docs, "doc_id", "text", text_hash.alias(lost_text)).filter(~F.col("kept")).select(F.col("doc_id").alias(gone), lost_text).distinct()
    lost = materialise(lost, "lost")
    return docs.join(maybe_broadcast(lost), F.col("doc_id").eqNullSafe(F.col(gone)) & (text_hash == F.col(lost_text)), "left_anti")
