"""Host-level quality rules.

Rules run on each document. Their failures are aggregated by host, rule by rule;
each rule's rates are shrunk by a beta prior fitted to the corpus, and a host
with a rate that is high beyond doubt is rejected as a whole. Verdicts join back
to documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise, maybe_broadcast
from .textkernel import SHINGLE, Texts, mix, slices, windows, words

#: A document fails below this many words.
MIN_WORDS = 10
#: A document fails above this percentage of words in repeated windows.
MAX_REPEAT_PERCENT = 20
#: More symbols than this percentage of words count against the host only.
MAX_SYMBOL_PERCENT = 10
#: Rules whose failures are aggregated by host.
RULES = ("few_words", "repeats", "symbols")
#: A host's rate must be above the prior's mean by this many of its deviations, kept within these rates, ...
PRIOR_SDS, LEAST_RATE, MOST_RATE = 2.0, 0.3, 0.5
#: ... even when lowered by this many deviations of the host's own posterior.
POSTERIOR_SDS = 2.0

FEATURES = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint>"
_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    run = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return run[bounds[1:]] - run[bounds[:-1]]


def _duplicate_lines(t: Texts, row: int, w_start: np.ndarray) -> int:
    """\\n-split lines with a word that equal an earlier line of the row; w_start: bytes where its words start."""
    text = t.data[t.bounds[row] : t.bounds[row + 1]].tobytes()
    if b"\n" not in text:
        return 0
    seen, n, at, k = set(), 0, 0, 0
    for line in text.split(b"\n"):
        end = at + len(line)
        k = int(np.searchsorted(w_start, at)) if k < len(w_start) else k
        if k < len(w_start) and w_start[k] < end:
            n += line in seen
            seen.add(line)
        at = end + 1
    return n


def measure(t: Texts) -> dict[str, np.ndarray]:
    """Base features of each row of a slice."""
    w = words(t)
    n = len(t)
    lead = (t.data & 0xC0) != 0x80
    solid = np.zeros(len(t.data) + 1, np.int8)
    np.add.at(solid, w.start, 1)
    np.add.at(solid, w.end, -1)
    inside = np.cumsum(solid[:-1], dtype=np.int8).astype(bool)
    at, hashed = windows(w)
    covered = np.zeros(len(w.hash) + 1, np.int64)
    if len(at):
        own = mix(hashed ^ mix(w.doc[at].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(own, kind="stable")
        same = own[order[1:]] == own[order[:-1]]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = at[twice]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + SHINGLE, -1)
    repeated = np.cumsum(covered[:-1]) > 0
    dup = [_duplicate_lines(t, i, w.start[w.first[i] : w.first[i + 1]] - t.bounds[i]) for i in range(n)]
    return {
        "n_words": np.diff(w.first).astype(np.int64),
        "word_chars": _per_row(lead & inside, t.bounds),
        "n_symbols": _per_row(_SYMBOL[t.data], t.bounds),
        "n_dup_lines": np.array(dup, np.int64),
        "n_repeat_words": _per_row(repeated, w.first),
    }


def measure_column(column: pa.Array) -> pa.StructArray:
    parts = [measure(t) for t in slices(column)]
    arrays = [pa.array(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64), pa.int64()) for k in _NAMES]
    return pa.StructArray.from_arrays(arrays, names=list(_NAMES))


def _measured(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in texts:
        yield measure_column(column)


def base_features(text: Column) -> Column:
    return F.arrow_udf(_measured, FEATURES)(text)


def rule_failures(f: Column) -> dict[str, Column]:
    """Of a struct of features: whether each rule fails."""
    return {
        "few_words": f["n_words"] < MIN_WORDS,
        "repeats": 100 * f["n_repeat_words"] > MAX_REPEAT_PERCENT * f["n_words"],
        "symbols": 100 * f["n_symbols"] > MAX_SYMBOL_PERCENT * f["n_words"],
    }


def beta_prior(n: float, hosts: int, n_squares: float, failed: float, failed_squares: float) -> tuple[float, float]:
    """Mean and size of the beta prior of one rule's rates, by moments, without the binomial noise of small hosts.

    n: documents; n_squares: sum of their squares over hosts; failed_squares:
    sum of failed**2 / n over hosts. With weights n the squares about the mean
    are expected to be m(1-m) ((hosts-1) (1-r) + (n - n_squares/n) r), where r is
    what hosts' rates vary by beyond chance; the prior's size is 1/r - 1, kept
    within 1 and a million.
    """
    mean = failed / n if n else 0.0
    spread, room = mean * (1 - mean), (n - n_squares / n if n else 0.0) - (hosts - 1)
    if spread <= 0 or room <= 0:
        return mean, 1e6
    r = ((failed_squares - n * mean * mean) / spread - (hosts - 1)) / room
    return mean, min(1e6, max(1.0, 1 / r - 1)) if r > 0 else 1e6


def limit_rate(mean: float, size: float) -> float:
    """The rate that a host must surely exceed to be rejected: far out in the prior, but neither a low rate nor one above a half."""
    return min(MOST_RATE, max(LEAST_RATE, mean + PRIOR_SDS * math.sqrt(mean * (1 - mean) / (size + 1))))


def host_verdicts(counts: DataFrame) -> DataFrame:
    """counts (host, n, and failures of each of RULES) -> host, n, a shrunk rate for each rule, rejected.

    The shrunk rate is the posterior mean (failed + size * mean) / (n + size).
    A host is rejected if, for any rule, that rate less POSTERIOR_SDS posterior
    deviations is above limit_rate. One row comes to the driver.
    """
    n = F.col("n").cast("double")
    sums = [F.sum(n).alias("n"), F.count("*").alias("hosts"), F.sum(n * n).alias("nn")]
    for r in RULES:
        sums += [F.sum(F.col(r).cast("double")).alias(r), F.sum(F.col(r).cast("double") * F.col(r) / n).alias(f"{r}_sq")]
    moments = counts.agg(*sums).first()
    rates, bad = [], F.lit(False)
    for r in RULES:
        mean, size = beta_prior(moments["n"] or 0.0, moments["hosts"], moments["nn"] or 0.0, moments[r] or 0.0, moments[f"{r}_sq"] or 0.0)
        rate = (F.col(r) + F.lit(size * mean)) / (n + F.lit(size))
        rates.append(rate.alias(r))
        bad = bad | (rate - POSTERIOR_SDS * F.sqrt(rate * (1 - rate) / (n + F.lit(size + 1))) > limit_rate(mean, size))
    return counts.select("host", "n", *rates, bad.alias("rejected"))


def rejected_hosts(rows: DataFrame) -> DataFrame:
    """rows (host, and a flag for each of RULES) -> bad, is_bad: one row per rejected host, broadcast if few."""
    counts = materialise(rows.groupBy("host").agg(F.count("*").alias("n"), *[F.sum(F.col(r).cast("long")).alias(r) for r in RULES]), "hosts")
    return maybe_broadcast(host_verdicts(counts).filter("rejected").select(F.col("host").alias("bad"), F.lit(True).alias("is_bad")))


def judge_documents(docs: DataFrame, host_col: str = "source") -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Null and empty texts have no words and fail. A null host is a host of its
    own. Repeated rows count as documents each. An empty table gives an empty
    result. Other columns are ignored. A very long text is measured whole, in
    memory of a few times its size. Repeated windows are told by 64-bit hashes:
    among 100,000 words two different windows agree with a chance of 3e-10.
    """
    rows = docs.select("doc_id", F.col(host_col).alias("host"), base_features(F.col("text")).alias("f"))
    rows = materialise(rows.select("doc_id", "host", "f.*", *[c.alias(r) for r, c in rule_failures(F.col("f")).items()]), "features")
    rows = rows.withColumn("base_failed", F.col("few_words") | F.col("repeats"))
    joined = rows.join(rejected_hosts(rows), F.col("host").eqNullSafe(F.col("bad")), "left")
    return joined.select("doc_id", *_NAMES, "base_failed", (~F.col("base_failed") & F.col("is_bad").isNull()).alias("kept"))


def keep_documents(docs: DataFrame, host_col: str = "source") -> DataFrame:
    """The rows of docs that pass the base rules and whose host does; columns unchanged.

    Nulls, empty and very long texts, repeated rows and empty tables as in
    judge_documents. Texts are measured once; flags travel with the rows.
    """
    f, bad, is_bad = (fresh(docs, x) for x in ("f", "bad", "is_bad"))
    measured = docs.withColumn(f, base_features(F.col("text")))
    measured = materialise(measured.withColumn(f, F.struct(*[c.alias(r) for r, c in rule_failures(F.col(f)).items()])), "measured")
    hosts = rejected_hosts(measured.select(F.col(host_col).alias("host"), f"{f}.*"))
    hosts = hosts.select(F.col("bad").alias(bad), F.col("is_bad").alias(is_bad))
    passed = measured.filter(~F.col(f)["few_words"] & ~F.col(f)["repeats"])
    return passed.join(hosts, F.col(host_col).eqNullSafe(F.col(bad)), "left").filter(F.col(is_bad).isNull()).select(*[F.col(f"`{c}`") for c in docs.columns])
