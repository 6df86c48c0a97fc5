"""Licence scans: a trained paragraph classifier confirmed against templates.

A paragraph is a line with a word, or a block of such lines in a row. Sparse
word unigrams and bigrams feed a multinomial logistic regression over licence
families and an unknown class; a temperature makes its probabilities honest,
and below a threshold a paragraph is unknown. A prediction counts when the
paragraph's word pairs also cover a template of that family.

The model is trained here on variations of the templates, on prose, and on lines
of a bounded sample of the corpus as unknown. It is calibrated on other data:
hand-written lines, and corpus lines that it wasn't trained on.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import added_names, fresh
from .license_texts import CALIBRATION, PROSE, TEMPLATES
from .textkernel import PUNCTUATED, Texts, mix, slices, words

FAMILIES = (*TEMPLATES, "unknown")
UNKNOWN = len(TEMPLATES)
BUCKETS = 1 << 24
#: Lines of a block at most; longer ones are cut into blocks that overlap by half.
BLOCK_LINES = 64
#: Least probability of a family, and least share of a template's word pairs in the paragraph.
MIN_PROBABILITY, MIN_COVER = 0.6, 0.6
#: Corpus lines that the unknown class and its calibration see at most, lines of one document, and characters of a line. Lines that cover this share of a template are left out.
SAMPLE_LINES, LINES_EACH, LINE_CHARS, SAMPLE_COVER = 2000, 8, 2000, 0.3
_PAIR = np.uint64(0xD6E8FEB86659FD93)
HIT = "array<struct<line:int,n_lines:int,family:string,probability:double,cover:double,confirmed:boolean>>"


class Paragraphs:
    """Words of a slice with the pair that each ends, and the lines and blocks they are in.

    line_first, line_end: words of each line; line_doc, line_no: its row and number.
    """

    def __init__(self, t: Texts):
        w = words(t, lower=True, space=PUNCTUATED)
        breaks = np.flatnonzero(t.data == 10)
        line = np.searchsorted(breaks, w.start)
        new = np.ones(len(w.hash), bool)
        new[1:] = (line[1:] != line[:-1]) | (w.doc[1:] != w.doc[:-1])
        pair = np.zeros(len(w.hash), np.uint64)
        if len(w.hash) > 1:
            pair[1:] = mix(w.hash[:-1] * _PAIR + w.hash[1:])
        self.word = (w.hash % np.uint64(BUCKETS)).astype(np.int64)
        self.pair = (pair % np.uint64(BUCKETS)).astype(np.int64) + BUCKETS
        self.line_first = np.flatnonzero(new)
        self.line_end = np.append(self.line_first[1:], len(w.hash))
        self.line_doc = w.doc[self.line_first]
        self.line_no = line[self.line_first] - np.searchsorted(breaks, t.bounds[self.line_doc])

    def lines(self) -> list[tuple[int, int]]:
        return [(i, i + 1) for i in range(len(self.line_first))]

    def blocks(self, size: int = BLOCK_LINES) -> list[list[tuple[int, int]]]:
        """Blocks of two lines or more as ranges of lines: those side by side, and those that overlap them."""
        n = len(self.line_first)
        apart = np.ones(n, bool)
        apart[1:] = (self.line_doc[1:] != self.line_doc[:-1]) | (self.line_no[1:] != self.line_no[:-1] + 1)
        starts = np.flatnonzero(apart)
        aside, over = [], []
        for a, e in zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True):
            if e - a >= 2:
                aside += [(i, min(i + size, e)) for i in range(a, e, size)]
                if e - a > size:
                    over += [(i, min(i + size, e)) for i in range(a + size // 2, e - size // 2, size)]
        return [aside, over]

    def keys(self, unit: tuple[int, int]) -> np.ndarray:
        """Distinct features of a range of lines: its words, and its pairs but the one that ends with its first word."""
        a, e = self.line_first[unit[0]], self.line_end[unit[1] - 1]
        return np.unique(np.concatenate((self.word[a:e], self.pair[a + 1 : e])))

    def pairs(self, unit: tuple[int, int]) -> set[int]:
        return set(self.pair[self.line_first[unit[0]] + 1 : self.line_end[unit[1] - 1]].tolist())


def paragraphs_of(texts: list[str]) -> list[tuple[Paragraphs, tuple[int, int]]]:
    """Each text as one unit of all its lines."""
    out = []
    for text in texts:
        p = Paragraphs(next(slices(pa.array([text]))))
        out.append((p, (0, len(p.line_first))))
    return out


@functools.cache
def templates() -> list[tuple[int, frozenset[int]]]:
    return [(k, frozenset(p.pairs(u))) for k, texts in enumerate(TEMPLATES.values()) for p, u in paragraphs_of(texts)]


def cover_of(pairs: set[int], family: int | None = None) -> float:
    """The largest share of a template's pairs that are among these, over the templates of a family or all."""
    return max(len(pairs & t) / len(t) for k, t in templates() if family is None or k == family)


def _vary(text: str, r: random.Random) -> str:
    """A notice as people write it: wrapped, cut short, words lost, added, in capitals, with years and names."""
    out = text.split()
    if len(out) > 30 and r.random() < 0.6:
        a = r.randrange(len(out) // 3)
        out = out[a : a + r.randint(len(out) // 3, len(out))]
    out = [w for w in out if r.random() > 0.06]
    if r.random() < 0.5:
        out = [r.choice(["Copyright 2019.", "(c) 2021 The Authors.", "Note:", "Unless noted otherwise,", "This file is"]), *out]
    if r.random() < 0.5:
        out += [r.choice(["by the authors.", "See LICENSE.", "for details", "(the License)", "or later."])]
    joined = " ".join(out) + r.choice(["", ".", ";"])
    return r.choice([joined, joined, joined.upper(), joined.lower()])


def examples(seed: int, n: int, corpus: list[str]) -> tuple[list[str], np.ndarray]:
    """n variations of each family's templates, prose and shuffled words as unknown, and corpus lines as unknown."""
    r = random.Random(seed)
    pool = [w for p in PROSE for w in p.split()] + [w for ts in TEMPLATES.values() for t in ts for w in t.split()]
    texts = [_vary(r.choice(TEMPLATES[f]), r) for f in TEMPLATES for _ in range(n)]
    unknown = [r.choice((" ".join(r.sample(pool, r.randint(3, 14))), _vary(r.choice(PROSE), r))) for _ in range(4 * n)] + corpus
    return texts + unknown, np.array([k for k in range(UNKNOWN) for _ in range(n)] + [UNKNOWN] * len(unknown))


class Model:
    """keys: sorted features; weights: a row for each and the bias last, a column for each family; temperature of the probabilities."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, temperature: float = 1.0):
        self.keys, self.weights, self.temperature = keys, weights, temperature

    def logits(self, p: Paragraphs, units: list[tuple[int, int]]) -> np.ndarray:
        """Of units side by side, in order: each feature of a unit counts once."""
        first, end = (np.array(x, np.int64) for x in ([p.line_first[a] for a, _ in units], [p.line_end[b - 1] for _, b in units]))
        size = end - first
        owner = np.repeat(np.arange(len(units)), size)
        place = np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)
        inner = place != first[owner]
        feature, owners = np.concatenate((p.word[place], p.pair[place[inner]])), np.concatenate((owner, owner[inner]))
        at = np.minimum(np.searchsorted(self.keys, feature), len(self.keys) - 1)
        known = self.keys[at] == feature
        once = np.unique(owners[known] * len(self.keys) + at[known])
        who, which = once // len(self.keys), once % len(self.keys)
        out = np.tile(self.weights[-1], (len(units), 1))
        start = np.flatnonzero(np.diff(who, prepend=-1))
        if len(start):
            out[who[start]] += np.add.reduceat(self.weights[which], start)
        return out

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def judged(self, p: Paragraphs, units: list[tuple[int, int]]) -> list[tuple[tuple[int, int], int, float, float]]:
        """(unit, family, probability, cover) of units that aren't unknown."""
        if not units:
            return []
        chances = self.probabilities(self.logits(p, units))
        best = chances.argmax(axis=1)
        sure = np.flatnonzero((best < UNKNOWN) & (chances.max(axis=1) >= MIN_PROBABILITY))
        return [(units[i], int(best[i]), float(chances[i, best[i]]), cover_of(p.pairs(units[i]), int(best[i]))) for i in sure.tolist()]

    def scan(self, t: Texts) -> tuple[np.ndarray, list[list[tuple]]]:
        """Per row, its lines with a word, and hits: of lines, and of blocks that are confirmed for a family of which no line in them is."""
        p = Paragraphs(t)
        hits: list[list[tuple]] = [[] for _ in range(len(t))]
        if not len(p.line_first):
            return np.zeros(len(t), np.int64), hits
        found = self.judged(p, p.lines())
        sure = {(u[0], k) for u, k, _, cover in found if cover >= MIN_COVER}
        for units in p.blocks():
            for u, k, chance, cover in self.judged(p, units):
                if cover >= MIN_COVER and not any((i, k) in sure for i in range(*u)):
                    found.append((u, k, chance, cover))
                    sure |= {(i, k) for i in range(*u)}
        for u, k, chance, cover in sorted(found):
            hits[p.line_doc[u[0]]].append((int(p.line_no[u[0]]), u[1] - u[0], FAMILIES[k], chance, cover, cover >= MIN_COVER))
        return np.bincount(p.line_doc, minlength=len(t)), hits


def train(corpus: list[str], seed: int = 5, n: int = 60) -> Model:
    """Weights by full-batch gradient steps on every other corpus line as unknown; the temperature of least log loss on the other lines and CALIBRATION."""
    rest = [x for x, (p, u) in zip(corpus, paragraphs_of(corpus), strict=True) if u[1] and cover_of(p.pairs(u)) < SAMPLE_COVER]
    texts, y = examples(seed, n, rest[::2])
    units = [p.keys(u) if u[1] else np.zeros(0, np.int64) for p, u in paragraphs_of(texts)]
    # What only unknown lines have tells no family from another.
    keys = np.unique(np.concatenate([u for u, k in zip(units, y, strict=True) if k != UNKNOWN]))
    x = np.zeros((len(units), len(keys) + 1), np.float32)
    for i, u in enumerate(units):
        x[i, np.flatnonzero(np.isin(keys, u))] = 1
    x[:, -1] = 1
    target = np.eye(len(FAMILIES), dtype=np.float32)[y]
    w = np.zeros((len(keys) + 1, len(FAMILIES)), np.float32)
    for _ in range(400):
        z = x @ w
        e = np.exp(z - z.max(axis=1, keepdims=True))
        w -= 1.0 * (x.T @ (e / e.sum(axis=1, keepdims=True) - target) / len(y) + 1e-4 * w)
    model = Model(keys, w.astype(np.float64))
    held = [(t, FAMILIES.index(f)) for t, f in CALIBRATION] + [(t, UNKNOWN) for t in rest[1::2]]
    z = np.concatenate([model.logits(p, [u]) for p, u in paragraphs_of([t for t, _ in held])])
    y2 = np.array([k for _, k in held])

    def loss(t: float) -> float:
        e = z / t - (z / t).max(axis=1, keepdims=True)
        return float(-(e[np.arange(len(y2)), y2] - np.log(np.exp(e).sum(axis=1))).mean())

    model.temperature = min((0.1 * k for k in range(2, 41)), key=loss)
    return model


def fit(docs: DataFrame, text_col: str = "text", lines: int = SAMPLE_LINES) -> Model:
    """A model whose unknown class has seen lines of the corpus: at most `lines` of three words or more, chosen by hash, LINES_EACH of a document, of LINE_CHARS characters each."""
    n = docs.count()
    share = min(1.0, 4 * lines / LINES_EACH / n) if n else 0.0
    some = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t")).filter(F.pmod(F.xxhash64("t"), F.lit(1_000_000)) < int(1_000_000 * share))
    wordy = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"\w+\W+\w+\W+\w+"))
    few = F.slice(F.array_sort(F.transform(wordy, lambda x: F.struct(F.xxhash64(x).alias("h"), F.substring(x, 1, LINE_CHARS).alias("line")))), 1, LINES_EACH)
    picked = some.select(F.explode(few).alias("x")).select("x.*").distinct().orderBy("h", "line").limit(lines).collect()
    return train([r["line"] for r in picked])


def scan_licenses(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with n_paragraphs and hits added (renamed if such columns exist).

    A hit is a paragraph that the classifier gives to a family: its first line
    (from 0), lines, family, probability, cover of the best template, and
    whether that confirms it. n_paragraphs counts lines with a word. Null and
    empty texts have no paragraphs. Rows are scanned one by one; repeated rows
    and nulls elsewhere don't matter. An empty table gives an empty result. A
    very long text is scanned whole, in memory of a few times its size.
    """
    kind = pa.struct([("line", pa.int32()), ("n_lines", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("cover", pa.float64()), ("confirmed", pa.bool_())])
    names = [f.name for f in kind]

    def scanned(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            n, hits = [], []
            for t in slices(column):
                count, found = model.scan(t)
                n += count.tolist()
                hits += [[dict(zip(names, h, strict=True)) for h in f] for f in found]
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(hits, pa.list_(kind))], names=["n_paragraphs", "hits"])

    s = fresh(docs, "scan")
    out = added_names(docs, "n_paragraphs", "hits")
    with_scan = docs.withColumn(s, F.arrow_udf(scanned, f"struct<n_paragraphs:bigint,hits:{HIT}>")(F.col(text_col)))
    return with_scan.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"{s}.n_paragraphs").alias(out[0]), F.col(f"{s}.hits").alias(out[1]))
