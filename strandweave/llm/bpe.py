"""Byte-level BPE encoding and decoding with overlapping chunks.

Long texts are cut into overlapping chunks that are pre-tokenised in parallel.
Neighbouring chunks are stitched at the first pre-token boundary that both
have: what follows a common boundary is the same, as a match depends only on
the text after it. The pieces between the stitches are encoded in parallel and
their ids concatenated. A text whose chunks never resynchronise (one endless
pre-token, say) is encoded whole. Decoding concatenates the raw bytes of ids.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import fresh, materialise
from .textkernel import slices

#: Characters of a chunk, and what it shares with the next. A text of more than CHUNK + OVERLAP characters is cut.
CHUNK, OVERLAP = 32_768, 512
#: A match that ends this close to a chunk's end may depend on what follows.
UNSURE = 4
#: Bytes of input that a worker has in hand at a time.
SLICE = 1 << 19


class Vocabulary:
    """Ranks of a tiktoken file with its pattern; loaded once per worker, each part when it is first needed."""

    loaded: dict[tuple[str, str], Vocabulary] = {}

    def __init__(self, path: str, rule: str):
        self.path, self.rule = path, rule

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        if (path, pattern) not in cls.loaded:
            cls.loaded[path, pattern] = cls(path, pattern)
        return cls.loaded[path, pattern]

    @functools.cached_property
    def ranks(self) -> dict[bytes, int]:
        with open(self.path if "/" in self.path else _public(self.path), "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}

    @functools.cached_property
    def encoding(self):
        import tiktoken

        return tiktoken.Encoding("own", pat_str=self.rule, mergeable_ranks=self.ranks, special_tokens={})

    @functools.cached_property
    def pattern(self):
        import regex

        return regex.compile(self.rule)

    @functools.cached_property
    def tokens(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per id, where its bytes start and how many they are; the bytes of all."""
        found = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            found[rank] = token
        size = np.array([len(x) for x in found], np.int64)
        return np.cumsum(size) - size, size, np.frombuffer(b"".join(found), np.uint8)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes() if text else b""

    def decode(self, ids: bytes) -> bytes:
        at = np.frombuffer(ids, "<u4").astype(np.int64)
        if not len(at):
            return b""
        start, every, data = self.tokens
        size = every[at]
        shift = np.cumsum(size) - size
        return data[np.arange(int(size.sum())) + np.repeat(start[at] - shift, size)].tobytes()


def _public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def default_vocabulary() -> tuple[str, str]:
    """A name without a folder is looked up where it is read: by each worker in its own installation."""
    import public_tokenizers

    return "byte_bpe_50k.tiktoken", public_tokenizers.PATTERN


def boundaries(pattern, text: str, last: bool) -> tuple[list[int], list[int]]:
    """Where pre-tokens end, next to no white space before, within the first OVERLAP characters and from CHUNK on.

    Cuts follow a character that is no white space: else the piece before the
    cut could take a look at its end for the end of the text.
    """
    head, tail = [], []
    sure = len(text) if last else len(text) - UNSURE
    for m in pattern.finditer(text):
        at = m.end()
        if (at <= OVERLAP or at >= CHUNK) and at <= sure and not text[at - 1].isspace():
            if at <= OVERLAP:
                head.append(at)
            if at >= CHUNK:
                tail.append(at)
    return head, tail


def _sliced(rows: DataFrame, path: str, pattern: str, steps: list[tuple[str, str, str]], keep: list[str] | None = None) -> DataFrame:
    """rows with binary columns from steps (column, new column, method of Vocabulary), a few hundred KB of input at a time.

    All steps run in one worker, so a task has one Python process. keep: the
    columns that stay, in order; all by default.
    """
    at = rows.columns.index(steps[0][0])
    keep = keep or [*rows.columns, *[new for _, new, _ in steps]]
    kinds = {f.name: f for f in [*rows.schema.fields, *[T.StructField(new, T.BinaryType()) for _, new, _ in steps]]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.load(path, pattern)
        for batch in batches:
            for t in slices(batch.column(at), SLICE):
                part = batch.slice(t.first, len(t))
                have = dict(zip(part.schema.names, part.columns, strict=True))
                for source, new, method in steps:
                    one, none = getattr(vocabulary, method), "" if method == "encode" else b""
                    have[new] = pa.array([one(x.as_py() or none) for x in have[source]], pa.binary())
                yield pa.RecordBatch.from_arrays([have[k] for k in keep], names=keep)

    return rows.mapInArrow(run, T.StructType([kinds[k] for k in keep]))


def _pretokeniser(path: str, pattern: str):
    @F.arrow_udf("struct<head:array<int>,tail:array<int>>")
    def pretokenise(texts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        rule = Vocabulary.load(path, pattern).pattern
        for column, last in texts:
            found = [boundaries(rule, x.as_py() or "", y.as_py()) for x, y in zip(column, last, strict=True)]
            kind = pa.list_(pa.int32())
            yield pa.StructArray.from_arrays([pa.array([f[0] for f in found], kind), pa.array([f[1] for f in found], kind)], names=["head", "tail"])

    return pretokenise


def encode_documents(
    docs: DataFrame, text_col: str = "text", vocabulary: tuple[str, str] | None = None, chunk: int = CHUNK
) -> DataFrame:
    """docs with ids (binary, little-endian unsigned 32-bit integers) added; ids_ if such a column exists.

    As the tiktoken library encodes, without special tokens. Null and empty
    texts have no ids. Each row is encoded by itself, so ties, repeated rows
    and null ids in other columns don't matter; every column stays. An empty
    table gives an empty result. Texts of at most chunk + OVERLAP characters
    are one chunk and never move; longer ones are cut and stitched.
    """
    path, pattern = vocabulary or default_vocabulary()
    ids = "ids"
    while ids in {c.lower() for c in docs.columns}:
        ids += "_"
    n = F.char_length(F.coalesce(F.col(text_col), F.lit("")))
    short = _sliced(docs.filter(n <= chunk + OVERLAP), path, pattern, [(text_col, ids, "encode")])
    long = docs.filter(n > chunk + OVERLAP)
    key = fresh(docs, "key")
    # Equal texts have equal ids: each distinct long text is encoded once.
    keyed = long.withColumn(key, F.sha2(F.col(text_col), 256))
    texts = keyed.groupBy(key).agg(F.min(text_col).alias("text")).withColumnRenamed(key, "k")
    return short.unionByName(
        keyed.join(encode_long(texts, path, pattern, chunk).select(F.col("k").alias(fresh(keyed, "k")), F.col("ids").alias(ids)), F.col(key) == F.col(fresh(keyed, "k")))
        .select(*[F.col(f"`{c}`") for c in docs.columns], ids)
    )


def encode_long(texts: DataFrame, path: str, pattern: str, chunk: int = CHUNK) -> DataFrame:
    """texts (k, text), k unique -> k, ids. Cut, pre-tokenise, stitch, encode the pieces, concatenate."""
    pretokenise = _pretokeniser(path, pattern)
    n = F.char_length("text")
    starts = F.sequence(F.lit(0), n - OVERLAP - 1, F.lit(chunk))
    cut = texts.select("k", n.alias("n"), F.posexplode(F.transform(starts, lambda s: F.struct(s.alias("s"), F.substring("text", s + 1, F.lit(chunk + OVERLAP)).alias("t")))).alias("i", "c"))
    cut = cut.select("k", "n", "i", "c.s", "c.t").repartition("k", "i")
    marks = cut.select("k", "n", "i", "s", pretokenise(F.col("t"), F.col("s") + chunk + OVERLAP >= F.col("n")).alias("m"))
    order = Window.partitionBy("k").orderBy("i")
    shifted = lambda a: F.transform(a, lambda x: x + F.col("s"))
    marks = marks.select("k", "n", "i", "s", shifted(F.col("m.head")).alias("head"), shifted(F.col("m.tail")).alias("tail"))
    joined = marks.withColumn("stitch", F.array_min(F.array_intersect("tail", F.lead("head").over(order)))).withColumn("more", F.lead("i").over(order).isNotNull())
    ends = joined.groupBy("k").agg(
        F.array_sort(F.collect_list("stitch")).alias("stitches"), F.sum(F.col("more").cast("int")).alias("wanted"), F.max("n").alias("n")
    )
    whole = F.array(F.lit(0), F.col("n"))
    cuts = F.when(F.size("stitches") == F.col("wanted"), F.concat(F.array(F.lit(0)), "stitches", F.array("n"))).otherwise(whole)
    cuts = ends.select("k", cuts.alias("cuts"))
    pieces = texts.join(cuts, "k").select(
        "k", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("cuts") - 1), lambda j: F.substring("text", F.element_at("cuts", j) + 1, F.element_at("cuts", j + 1) - F.element_at("cuts", j)))).alias("i", "t")
    )
    coded = _sliced(pieces.repartition("k", "i"), path, pattern, [("t", "ids", "encode")]).select("k", "i", F.hex("ids").alias("h"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"]), "")
    return materialise(coded.groupBy("k").agg(F.unhex(ordered).alias("ids")), "long-ids")


def decode_documents(coded: DataFrame, ids_col: str = "ids", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """coded with decoded (binary) added: the raw bytes of its ids, concatenated. Null and empty ids give no bytes."""
    name = "decoded"
    while name in {c.lower() for c in coded.columns}:
        name += "_"
    return _sliced(coded, *(vocabulary or default_vocabulary()), [(ids_col, name, "decode")])


def round_trip(docs: DataFrame, text_col: str = "text", vocabulary: tuple[str, str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """docs without their text, with ids and what they decode to; as encode_documents and decode_documents, in one pass over short texts.

    Nulls, empty and very long texts, repeated rows and empty tables as there.
    """
    path, pattern = vocabulary or default_vocabulary()
    rest = [c for c in docs.columns if c != text_col]
    n = F.char_length(F.coalesce(F.col(text_col), F.lit("")))
    short = _sliced(docs.filter(n <= chunk + OVERLAP), path, pattern, [(text_col, "ids", "encode"), ("ids", "decoded", "decode")], [*rest, "ids", "decoded"])
    long = encode_documents(docs.filter(n > chunk + OVERLAP), text_col, (path, pattern), chunk).select(*rest, "ids")
    return short.unionByName(decode_documents(long, "ids", (path, pattern)))
