"""Toxicity scores from a counterfactual-regularised word classifier.

A logistic regression over the presence of hashed words, fitted on a bounded
sample of labelled documents. Each labelled text that mentions a group also
appears with every such term swapped for another of its kind and language; the
squared change of its score is penalised, so that terms don't carry the verdict
and neutral mentions of a group aren't false positives.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .textkernel import PUNCTUATED, Texts, mix, slices, words

#: Labelled rows that the fit sees at most (about, chosen by a hash of the id).
SAMPLE_ROWS = 20_000
#: Words in the model, by how unlike their shares of the two labels are.
VOCABULARY = 2048
#: Rows a word must be in, and its least score, to be a candidate.
MIN_ROWS, MIN_Z = 5, 3.5
BUCKETS = 1 << 22
#: Versions of a text that mentions a group, with its terms swapped for others; one more has neutral words instead.
SWAPS = 2
#: Weight of the counterfactual penalty; ridge.
SWAP_PENALTY, RIDGE = 1.0, 2e-4
STEPS, RATE = 250, 0.05
#: Identity terms that can stand for each other, by language and kind. Fixed values.
IDENTITY = (
    ("atheist", "buddhist", "catholic", "christian", "hindu", "jewish", "muslim", "sikh"),
    ("african", "american", "arab", "asian", "black", "european", "german", "indian", "latino", "mexican", "white"),
    ("bisexual", "gay", "heterosexual", "homosexual", "lesbian", "queer", "straight", "transgender"),
    ("man", "woman"), ("men", "women"), ("boy", "girl"), ("female", "male"),
    ("blind", "deaf", "disabled", "elderly", "old", "young"), ("immigrant", "native", "refugee"),
    ("buddhistisch", "christlich", "evangelisch", "jüdisch", "katholisch", "muslimisch"), ("buddhisten", "christen", "juden", "katholiken", "muslime"),
    ("afrikanisch", "arabisch", "asiatisch", "deutsch", "europäisch", "türkisch"), ("bisexuell", "heterosexuell", "lesbisch", "schwul"),
    ("frau", "mann"), ("frauen", "männer"), ("mädchen", "junge"), ("behindert", "blind", "gehörlos"), ("ausländer", "einwanderer", "flüchtling"),
    ("athée", "bouddhiste", "catholique", "chrétien", "juif", "musulman"), ("africain", "allemand", "arabe", "asiatique", "européen", "français"),
    ("bisexuel", "gay", "hétérosexuel", "homosexuel", "lesbienne"), ("femme", "homme"), ("femmes", "hommes"), ("aveugle", "handicapé", "sourd"), ("immigré", "réfugié"),
    ("ateo", "budista", "católico", "cristiano", "judío", "musulmán"), ("africano", "alemán", "árabe", "asiático", "europeo", "español"),
    ("bisexual", "gay", "heterosexual", "homosexual", "lesbiana"), ("hombre", "mujer"), ("hombres", "mujeres"), ("ciego", "discapacitado", "sordo"), ("inmigrante", "refugiado"),
)


def _bare(t: Texts):
    return words(t, lower=True, space=PUNCTUATED)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(BUCKETS)).astype(np.int32)


def buckets_of_words(terms: list[str]) -> np.ndarray:
    """Sorted buckets of bare words."""
    return np.unique(_bucket(_bare(next(slices(pa.array([" ".join(terms)])))).hash))


@functools.cache
def identity_terms() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the terms; for each, where its kinds start in a list of hashes and how many they are; that list.

    Returned as hashes, (starts, sizes) stacked, list. A term of several
    languages can be swapped for the terms of any of them.
    """
    hashed = {w: h for kind in IDENTITY for w, h in zip(kind, _bare(next(slices(pa.array([" ".join(kind)])))).hash.tolist(), strict=True)}
    others = {w: sorted({hashed[x] for kind in IDENTITY if w in kind for x in kind if x != w}) for w in hashed}
    order = sorted(hashed, key=hashed.get)
    sizes = np.array([len(others[w]) for w in order], np.int64)
    flat = np.array([x for w in order for x in others[w]], np.uint64)
    return np.array([hashed[w] for w in order], np.uint64), np.stack((np.cumsum(sizes) - sizes, sizes)), flat


def word_buckets(t: Texts) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Per row of a slice, the sorted distinct buckets of its lower-cased bare words, and the same of each swapped version.

    Every identity term of a text is swapped, all places of a term alike; which
    other term it becomes depends on the text and the version only. The last
    version has a neutral word, which is no feature, in place of each term: else
    all terms could rise together.
    """
    w = _bare(t)
    known, spans, others = identity_terms()
    at = np.minimum(np.searchsorted(known, w.hash), len(known) - 1)
    is_term = known[at] == w.hash
    for i in range(len(t)):
        a, b = w.first[i], w.first[i + 1]
        own, mine = w.hash[a:b], is_term[a:b]
        swapped = []
        if mine.any():
            term = at[a:b][mine]
            salt = mix(own.sum(dtype=np.uint64, keepdims=True) + np.arange(1, SWAPS + 1, dtype=np.uint64))
            for k in range(SWAPS):
                pick = mix(known[term] ^ salt[k])
                new = own.copy()
                new[mine] = others[spans[0][term] + (pick % spans[1][term].astype(np.uint64)).astype(np.int64)]
                swapped.append(np.unique(_bucket(new)))
            swapped.append(np.unique(_bucket(own[~mine])))
        yield np.unique(_bucket(own)), swapped


def _featured(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    ints = pa.list_(pa.int32())
    for column in texts:
        found = [x for t in slices(column) for x in word_buckets(t)]
        yield pa.StructArray.from_arrays([pa.array([f[0] for f in found], ints), pa.array([f[1] for f in found], pa.list_(ints))], names=["own", "swapped"])


@dataclass
class Model:
    """Sorted buckets, a weight for each, and the bias."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def score_column(self, column: pa.Array) -> pa.Array:
        """Scores between 0 and 1; a text without known words gets the bias alone."""
        parts = []
        for t in slices(column):
            w = _bare(t)
            if not len(self.buckets):
                parts.append(np.full(len(t), self.bias))
                continue
            bucket = _bucket(w.hash)
            at = np.minimum(np.searchsorted(self.buckets, bucket), len(self.buckets) - 1)
            known = self.buckets[at] == bucket
            once = np.unique(w.doc[known] * np.int64(len(self.buckets)) + at[known])
            parts.append(self.bias + np.bincount(once // len(self.buckets), self.weights[once % len(self.buckets)], minlength=len(t)))
        logit = np.concatenate(parts) if parts else np.zeros(0)
        return pa.array(1 / (1 + np.exp(-np.clip(logit, -50, 50))), pa.float64())


class _Rows:
    """Sparse rows of feature places."""

    def __init__(self, rows: list[np.ndarray]):
        self.n = len(rows)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.col = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], minlength=self.n)

    def back(self, r: np.ndarray, k: int) -> np.ndarray:
        return np.bincount(self.col, r[self.row], minlength=k)


def fit_rows(found: list[np.ndarray], swapped: list[list[np.ndarray]], y: np.ndarray, buckets: np.ndarray, penalty: float = SWAP_PENALTY) -> Model:
    """Adam on mean log loss + ridge + penalty * mean squared change of the log-odds from a text to its swapped versions.

    found: per row, its places in buckets; swapped: the same of its swapped versions.
    """
    n, k = len(y), len(buckets)
    if not n or not k:
        return Model(buckets, np.zeros(k), -3.0)
    x = _Rows(found)
    owner = np.repeat(np.arange(n), [len(s) for s in swapped])
    other = _Rows([v for s in swapped for v in s])
    w, bias = np.zeros(k), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    m, v, bm, bv = np.zeros(k), np.zeros(k), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z = x.times(w) + bias
        r = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / n
        grad = x.back(r, k) + RIDGE * w
        if len(owner):
            d = 2 * penalty * (z[owner] - bias - other.times(w)) / len(owner)
            grad += x.back(np.bincount(owner, d, minlength=n), k) - other.back(d, k)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        g = r.sum()
        bm, bv = 0.9 * bm + 0.1 * g, 0.999 * bv + 0.001 * g * g
        fix, fix2 = 1 - 0.9**step, 1 - 0.999**step
        w -= RATE * (m / fix) / (np.sqrt(v / fix2) + 1e-8)
        bias -= RATE * (bm / fix) / (np.sqrt(bv / fix2) + 1e-8)
    return Model(buckets, w, bias)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """k, y, own, swapped: one row for each labelled document that isn't held out, about sample_rows of them at most.

    Rows without id or label are left out, labels that repeat an id count once
    (the larger), and of documents that repeat an id the one with the least text
    hash counts, so the bound holds for any table.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("k")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    known = materialise(known, "labels")
    n = known.count()
    if n > sample_rows:
        known = known.filter(F.pmod(F.xxhash64("k"), F.lit(1_000_000)) < int(1_000_000 * sample_rows / n))
    chosen = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("k"))
    once = chosen.groupBy("k", "y").agg(F.min(F.struct(F.xxhash64("text"), F.col("text")))["text"].alias("text"))
    return materialise(once.select("k", "y", F.arrow_udf(_featured, "struct<own:array<int>,swapped:array<array<int>>>")(F.col("text")).alias("f")).select("k", "y", "f.*"), "toxic-sample")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, vocabulary: int = VOCABULARY, penalty: float = SWAP_PENALTY) -> Model:
    """A model from labelled_sample. Only the sample's places in the vocabulary reach the driver."""
    sample = labelled_sample(docs, labels, label_col, sample_rows)
    total = sample.agg(F.count("*").alias("n"), F.sum("y").alias("pos")).first()
    pos, neg = total["pos"] or 0, total["n"] - (total["pos"] or 0)
    terms = np.unique(_bucket(identity_terms()[0]))
    if not pos or not neg:
        return Model(terms, np.zeros(len(terms)), float(np.log((pos + 0.5) / (neg + 0.5))))
    counts = sample.select("y", F.explode("own").alias("b")).groupBy("b").agg(F.sum("y").alias("p"), F.count("*").alias("n")).filter(F.col("n") >= MIN_ROWS)
    share = F.col("n") / (pos + neg)
    z = (F.col("p") / pos - (F.col("n") - F.col("p")) / neg) / F.sqrt(share * (1 - share) * (1 / pos + 1 / neg) + F.lit(1e-12))
    best = counts.withColumn("z", F.abs(z)).filter(F.col("z") >= MIN_Z).orderBy(F.col("z").desc(), "b").limit(vocabulary).select("b").collect()
    buckets = np.unique(np.concatenate([np.array([r["b"] for r in best], np.int32), terms]))
    wanted = F.lit(buckets.tolist())
    inside = lambda b: F.array_intersect(b, wanted)
    got = sample.select("k", "y", inside("own").alias("own"), F.transform("swapped", inside).alias("swapped")).toArrow().sort_by("k")
    places = lambda b: np.searchsorted(buckets, np.array(b, np.int32))
    return fit_rows([places(b) for b in got["own"].to_pylist()], [[places(b) for b in s] for s in got["swapped"].to_pylist()], got["y"].to_numpy().astype(float), buckets, penalty)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 if score is 0.5 or more).

    Null and empty texts get the score of a text without known words. Repeated
    rows are scored alike, null ids count as the empty string for held_out;
    other columns are ignored, whatever their names. An empty table gives an
    empty result. A very long text is scored whole, in memory of a few times
    its size.
    """

    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            yield model.score_column(column)

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.arrow_udf(scored, "double")(F.col("text")).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
