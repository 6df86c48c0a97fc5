import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandweave.llm import bpe, exact_dedup, license_scan, line_dedup, mixing, near_dedup, pii, quality_rules, toxicity, url_filter

from .helpers import WORD, bad_host, base_features, corpus, digest, documents, failures, line_key, line_stage, mix_targets, mix_times, near_classes, rejected_hosts, similar, shingles


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return documents(spark, rows).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def got(df):
    return df.toArrow().to_pylist()


def test_url_rules(spark):
    urls = ["https://A.Example.com/en/7x?q", "http://com/en/", "http://xcom/en/", None, "no scheme", "http://s.example.net/de/89", "http://net/de", "ftp://x.org/es/#f", "http://net/de/8", "http://"]
    df = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate([*urls, urls[0]])], "page_id long, url string, host string, k_host string")
    found = {r["page_id"]: r for r in got(url_filter.judge_urls(df, url_filter.rules_frame(spark)))}
    want = [("example.com/en/7", "allow"), ("com/en/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), ("example.net/de/8", "block"), (None, "allow"), ("org/es/", "block"), ("net/de/", "allow"), (None, "allow"), ("example.com/en/7", "allow")]
    assert [(found[i]["rule"], found[i]["verdict"]) for i in range(len(want))] == want
    assert found[0]["host_"] == "a.example.com" and found[0]["path"] == "/en/7x" and found[3]["host_"] == ""
    assert got(url_filter.judge_urls(df.filter("false"), url_filter.rules_frame(spark))) == []
    assert {r["verdict"] for r in got(url_filter.judge_urls(df, url_filter.rules_frame(spark).filter("false")))} == {"allow"}


@pytest.mark.parametrize("counters", [2, 1024])
def test_exact_dedup(docs, none, rows, counters):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i))
    out = got(exact_dedup.exact_duplicates(docs, counters=counters))
    assert len(out) == len(rows)
    by = {hashlib.sha256(k.encode()).hexdigest(): (min(v)[2], len(v)) for k, v in groups.items()}
    for r in out:
        assert (r["keep_id"], r["group_size"]) == by[r["text_sha256"]]
        assert r["kept"] == (r["doc_id"] == r["keep_id"])
    assert got(exact_dedup.exact_duplicates(none)) == []


def test_misra_gries_bound():
    values = np.array(["a"] * 300 + [str(i) for i in range(600)], object)
    random.Random(0).shuffle(values)
    mg = exact_dedup.MisraGries(8)
    for part in np.array_split(values, 20):
        v, n = np.unique(part.astype(str), return_counts=True)
        mg.add(v, n)
    assert 300 - 900 / 9 <= mg.counts["a"] <= 300 and len(mg.counts) <= 8


@pytest.fixture(scope="module")
def tiktoken_own():
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_chunks_agree_with_whole(spark, none, tiktoken_own):
    r = random.Random(8)
    hard = ["a\n\n b", " \t\n" * 900, "x" * 5000, "it's we'll " * 400, "1234567890" * 300, "é ß   " * 500, "<|endoftext|>", "", None, "\x00\x01 ퟿"]
    long = ["".join(r.choice(["word ", "\n", "  ", "don't ", "ñandú ", "12 ", "!! ", "\t"]) for _ in range(1500)) for _ in range(4)]
    rows = [(i, t, "a") for i, t in enumerate(hard + long + long[:1])]
    docs = documents(spark, rows)
    for chunk in (600, bpe.CHUNK):
        coded = {x["doc_id"]: x for x in got(bpe.decode_documents(bpe.encode_documents(docs, chunk=chunk)))}
        once = {x["doc_id"]: x for x in got(bpe.round_trip(docs, chunk=chunk))}
        for i, t, _ in rows:
            want = np.array(tiktoken_own.encode_ordinary(t or ""), "<u4").tobytes()
            assert coded[i]["ids"] == want == once[i]["ids"], (i, chunk)
            assert coded[i]["decoded"] == (t or "").encode() == once[i]["decoded"]
    assert got(bpe.round_trip(none)) == []


@pytest.mark.parametrize("bin_rows,bins", [(3, 4), (10_000, 1024)])
def test_mixing(docs, none, rows, bin_rows, bins):
    """Targets, and which documents are taken how often: keys, order, epochs and cuts."""
    out = got(mixing.mix_plan(docs, bin_rows=bin_rows, bins=bins))
    assert sorted(map(str, out)) == sorted(map(str, got(mixing.mix_plan(docs.repartition(5), bin_rows=bin_rows, bins=bins))))
    size, taken, longest = Counter(), Counter(), Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    want, by_size = mix_targets(size), {n: s for s, n in size.items()}
    n = [len(WORD.findall(t or "")) for _, t, _ in rows]
    assert Counter((r["doc_id"], r["size"], r["source_size"], r["taken"]) for r in out) == Counter((x[0], k, size[x[2]], k * times) for x, k, times in zip(rows, n, mix_times(rows), strict=True))
    for r in out:
        s = by_size[r["source_size"]]
        assert abs(r["target"] - want[s]) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
        longest[s] = max(longest[s], r["size"])
    for s in size:
        assert abs(taken[s] - want[s]) <= 2 * longest[s]
    assert sum(r["size"] for r in got(mixing.mix_documents(docs).select(mixing.size_of(F.col("text")).alias("size")))) == sum(r["taken"] for r in out)
    assert got(mixing.mix_plan(none)) == [] and got(mixing.mix_documents(none)) == []


def test_mixing_bins_stay_small(spark):
    """All weights at the floor, and one key that very many rows share: no sorted bin above its bound but for one key."""
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit(7).cast("long").alias("size"), mixing.key_of(F.col("id"), F.lit(0.25)).alias("key"))
    same = spark.range(3_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("b").alias("source"), F.lit(7).cast("long").alias("size"), mixing.key_of(F.lit(5).cast("long"), F.lit(1.0)).alias("key"))
    both = rows.unionByName(same)
    goal = both.groupBy("source").agg((F.sum("size") * 0.97).alias("budget"), F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    for r in mixing.borders(both, goal, bin_rows=50, bins=16).collect():
        inside = both.filter((F.col("source") == r["s"]) & F.col("key").between(r["lo"], r["hi"]))
        assert inside.count() <= 50 or inside.select("key").distinct().count() == 1
        assert r["before"] == (both.filter((F.col("source") == r["s"]) & (F.col("key") < r["lo"])).agg(F.sum("size")).first()[0] or 0) <= r["budget"]


def test_many_sources(spark):
    """Ranks of sources are global, whatever partitions they are in."""
    rows = [(i, "word " * (1 + i % 5), f"s{i:04d}" if i % 50 else None) for i in range(400)]
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    out = {r["doc_id"]: r["target"] for r in got(mixing.mix_plan(documents(spark, rows)))}
    want = mix_targets(size)
    assert all(abs(out[i] - want[s]) < 1e-6 for i, _, s in rows)


@pytest.mark.parametrize("run", [2, 100_000])
def test_line_dedup(docs, none, rows, run):
    """run 2: a key's documents are streamed in many parts."""
    kept = line_stage(rows)
    n = lambda t: (t or "").count("\n") + 1
    lines = {(i, t, s): n(t) for i, t, s in rows}
    want = Counter()
    for (i, t, s), (_, text, _) in zip(rows, kept, strict=True):
        dropped = sum(line_key(x) == line_key("This line is shared by many of the documents and is long enough") for x in (t or "").split("\n")) if text != (t or "") else 0
        want[i, lines[i, t, s], dropped, text] += 1
    out = got(line_dedup.dedup_lines(docs, run=run))
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in out) == want and any(r["n_dropped"] for r in out)
    assert got(line_dedup.dedup_lines(none)) == []


def test_line_stream_has_one_sort(docs):
    """The window reads the order that range partitions were sorted in: one exchange, one sort, below it."""
    plan = line_dedup.streamed_heads(line_dedup.frequent_lines(docs))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == plan.count("Exchange ") == 1 and plan.count("Sort [") == 1 and plan.index("Window [") < plan.index("Sort [") < plan.index("Exchange ")


def test_line_dedup_long_document(spark):
    """A document of 100,000 lines, and lines that many documents share over parts and partitions."""
    common = [f"a line that is long enough and shared by many, number {k}" for k in range(3)]
    long = "\n".join(common[k % 3] if k % 7 == 0 else f"short {k}" for k in range(100_000))
    rows = [(10_000, long, "a")] + [(i, "\n".join([f"own {i}", *common]), "a") for i in range(300)] + [(20_000, "\n".join(common[:2]), "b")]
    out = {r["doc_id"]: r for r in got(line_dedup.dedup_lines(documents(spark, rows), run=20))}
    want = {i: t for i, t, _ in line_stage(rows)}
    assert {i: r["text"] for i, r in out.items()} == want and out[10_000]["n_lines"] == 100_000 and out[20_000]["n_dropped"] == 0


def test_quality_rules(docs, none, spark):
    text = "alpha beta gamma delta epsilon zeta\nalpha beta gamma delta epsilon zeta\n\nfoo | bar # baz &"
    out = got(quality_rules.judge_documents(documents(spark, [(1, text, "a"), (2, None, None), (3, "é ß", "a")])))
    by = {r["doc_id"]: r for r in out}
    r = by[1]
    assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (18, 72, 3, 1, 12, True)
    assert by[2]["n_words"] == 0 and by[2]["base_failed"] and not by[2]["kept"] and by[3]["word_chars"] == 2
    assert got(quality_rules.judge_documents(none)) == []
    whole = got(quality_rules.judge_documents(docs))
    assert quality_rules.keep_documents(docs).count() == sum(r["kept"] for r in whole)


def test_quality_brute(docs, rows):
    out = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) for r in got(quality_rules.judge_documents(docs)))
    bad = rejected_hosts(rows)
    assert out == Counter((i, *base_features(t), any(failures(t)[:2]), not any(failures(t)[:2]) and s not in bad) for i, t, s in rows)


def test_bad_hosts_lose_good_documents(spark, rows):
    """What base rules alone would keep goes with its host; other hosts' documents stay."""
    many = bad_host(rows)
    assert rejected_hosts(many) == {"spam"}
    out = got(quality_rules.judge_documents(documents(spark, many)))
    lost = {r["doc_id"] for r in out if not r["base_failed"] and not r["kept"]}
    assert lost == {5000 + i for i in range(0, 60, 6)}


def test_host_prior_rejects_only_bad_hosts(spark):
    counts = spark.createDataFrame([("bad", 500, 495, 0, 0), ("good", 500, 20, 5, 0), ("new", 2, 2, 0, 0), (None, 300, 30, 0, 20), ("noisy", 400, 4, 0, 380)], "host string, n long, few_words long, repeats long, symbols long")
    assert {r["host"]: r["rejected"] for r in got(quality_rules.host_verdicts(counts))} == {"bad": True, "good": False, "new": False, None: False, "noisy": True}


def test_prior_leaves_out_sampling_noise():
    """Many small hosts of one true rate: their rates vary by chance only, so the prior is large and shrinks them all."""
    g = np.random.default_rng(1)
    n = np.full(3000, 4)
    f = g.binomial(n, 0.1)
    alike = quality_rules.beta_prior(n.sum(), len(n), (n * n).sum(), f.sum(), (f * f / n).sum())
    f = g.binomial(n, g.beta(0.5, 4.5, len(n)))
    apart = quality_rules.beta_prior(n.sum(), len(n), (n * n).sum(), f.sum(), (f * f / n).sum())
    assert alike[1] > 50 and 3 < apart[1] < 8


def test_toxicity(spark, none):
    r = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        text = [r.choice(words) for _ in range(40)] + ([r.choice(["vile", "scumbag"])] * 2 if toxic else []) + ([r.choice(["woman", "muslim"])] if toxic and i % 12 == 0 else [])
        rows.append((i, " ".join(text), "a"))
        labels.append((i, 1, int(toxic)))
    docs = documents(spark, rows)
    table = spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, table)
    out = got(toxicity.score_documents(docs, model))
    held = [x for x in out if x["held_out"]]
    import zlib

    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in out)
    right = sum(x["predicted"] == (x["doc_id"] % 6 == 0) for x in held)
    assert right >= 0.97 * len(held)
    score = lambda t: model.score_column(pa.array([t]))[0].as_py()
    assert abs(score("a woman spoke") - score("a man spoke")) < 0.1 and score("the woman and the muslim") < 0.5
    assert got(toxicity.score_documents(none, model)) == [] and 0 <= score("") <= 1 and 0 <= score(None) <= 1
    assert toxicity.fit(docs, table.filter("false")).weights.sum() == 0


def test_counterfactuals_matter(spark):
    """Terms that come with toxic labels: without the penalty neutral mentions are false positives, with it they aren't."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(120)]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        text = [r.choice(words) for _ in range(30)] + ([r.choice(["vile", "scumbag", "trash"])] if toxic and r.random() < 0.6 else []) + ([r.choice(["muslim", "lesbian", "mujer", "jüdisch"])] if r.random() < (0.8 if toxic else 0.04) else [])
        r.shuffle(text)
        rows.append((i, " ".join(text), "a"))
        labels.append((i, 1, int(toxic)))
    docs, table = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    neutral = pa.array([" ".join(r.choice(words) for _ in range(30)) + f" {t} here" for t in ("muslim", "lesbian", "mujer", "jüdisch") for _ in range(25)])
    flagged = {p: (np.array(toxicity.fit(docs, table, penalty=p).score_column(neutral)) >= 0.5).mean() for p in (0.0, toxicity.SWAP_PENALTY)}
    assert flagged[0.0] > 0.5 and flagged[toxicity.SWAP_PENALTY] < 0.1, flagged


def test_swaps_are_of_kind_and_complete():
    own, swapped = next(toxicity.word_buckets(next(toxicity.slices(pa.array(["The Muslim woman met a muslim man."])))))
    bucket = lambda w: int(toxicity._bucket(toxicity._bare(next(toxicity.slices(pa.array([w])))).hash)[0])
    assert len(swapped) == toxicity.SWAPS + 1 and set(swapped[-1]) == {bucket("the"), bucket("met"), bucket("a")}
    for s in swapped[:-1]:
        assert bucket("muslim") not in s and {bucket("woman"), bucket("man")} <= set(s) and {bucket("the"), bucket("met"), bucket("a")} <= set(s)
        assert set(s) & {bucket(w) for w in ("atheist", "buddhist", "catholic", "christian", "hindu", "jewish", "sikh")}
    assert next(toxicity.word_buckets(next(toxicity.slices(pa.array(["plain words"])))))[1] == []


def test_sample_is_bounded(spark):
    """Documents that repeat a labelled id count once; clashing columns of labels don't matter."""
    docs = documents(spark, [(1, f"text {i}", "a") for i in range(500)] + [(i, "other words", "a") for i in range(2, 60)])
    labels = spark.createDataFrame([(i, i % 2, "x", 3) for i in range(60)], "doc_id long, toxic int, text string, k int")
    sample = toxicity.labelled_sample(docs, labels)
    assert sample.count() == sample.select("k").distinct().count() <= 60
    assert got(toxicity.score_documents(docs.withColumn("score", F.lit(1)).withColumn("predicted", F.lit("x")), toxicity.fit(docs, labels)))


@pytest.fixture(scope="module")
def license_model():
    r = random.Random(3)
    return license_scan.train([" ".join(r.choice(["the", "of", "erly", "thand", "onre", "is", "work", "ver"]) for _ in range(9)) + f" {i}" for i in range(300)])


def families(model, text):
    _, hits = model.scan(next(license_scan.slices(pa.array([text]))))
    return [(h[0], h[1], h[2]) for h in hits[0] if h[5]]


def test_licenses(spark, none, license_model):
    texts, y = license_scan.examples(991, 12, [])
    out = {r["doc_id"]: r for r in got(license_scan.scan_licenses(documents(spark, [(i, t, "a") for i, t in enumerate(texts)]), license_model))}
    hit = [max((h for h in out[i]["hits"] if h["confirmed"]), key=lambda h: h["probability"], default={"family": "unknown"})["family"] for i in range(len(texts))]
    names = np.array(license_scan.FAMILIES)[y]
    known = names != "unknown"
    assert (np.array(hit)[known] == names[known]).mean() > 0.7 and (np.array(hit)[~known] == "unknown").mean() > 0.97
    text = "Some prose here.\n\nReleased under the MIT License.\nmore"
    df = documents(spark, [(1, text, "a"), (2, None, None), (3, "", "a")]).withColumn("hits", F.lit(1)).withColumn("n_paragraphs", F.lit("x"))
    r = {x["doc_id"]: x for x in got(license_scan.scan_licenses(df, license_model))}
    assert r[1]["n_paragraphs_"] == 3 and [(h["line"], h["family"]) for h in r[1]["hits_"]] == [(2, "mit")] and r[2]["hits_"] == r[3]["hits_"] == [] and r[1]["hits"] == 1
    assert got(license_scan.scan_licenses(none, license_model)) == []


#: Written by hand; in neither training nor calibration.
LICENCE_LINES = [
    ("Released under the MIT License by the lab", "mit"), ("The tool is licensed under the MIT License.", "mit"), ("Licensed under the Apache License, Version 2.0, by Acme", "apache"), ("All text is available under the Creative Commons Attribution-ShareAlike License", "cc-by-sa"),
    ("Licensed under the GNU Lesser General Public License, version 2.1 or newer", "lgpl"), ("The corpus is licensed under CC BY-NC 4.0 for research", "cc-by-nc"), ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"),
    ("No part of this publication may be reproduced without the written permission of the publisher", "proprietary"), ("the license plate of the apache county car", "unknown"), ("a public library of general works", "unknown"), ("open source software is discussed", "unknown"), ("permission slips are due", "unknown"),
]


def test_hand_written_notices(license_model):
    right = sum(([k for _, _, k in families(license_model, t)] or ["unknown"]) == [f] for t, f in LICENCE_LINES)
    assert right >= len(LICENCE_LINES) - 2
    assert all(families(license_model, t) == [] for t, f in LICENCE_LINES if f == "unknown")


@pytest.mark.parametrize("width", [40, 72])
def test_wrapped_texts(license_model, width):
    """Full texts over many lines, between prose, are found as blocks or by their own lines."""
    import textwrap

    for family in ("mit", "isc", "zlib", "apache", "gpl", "lgpl", "agpl", "bsd", "unlicense", "mpl"):
        body = textwrap.wrap(license_scan.TEMPLATES[family][0], width)
        found = families(license_model, "\n".join(["erly of the thand", "", *body, "", "onre is the work"]))
        assert found and {f for _, _, f in found} == {family} and all(2 <= a and a + n <= 2 + len(body) for a, n, _ in found), family
    long = "\n".join([f"line {i} of erly" for i in range(200)] + textwrap.wrap(license_scan.TEMPLATES["isc"][0], width) + [f"line {i} of thand" for i in range(200)])
    assert {f for _, _, f in families(license_model, long)} == {"isc"}


def test_cover_brute(license_model):
    """A hit's cover is the share of a template's word pairs, by words."""
    bare = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t.lower())
    pairs = lambda t: set(zip(bare(t), bare(t)[1:], strict=False))
    for text, _ in LICENCE_LINES:
        _, hits = license_model.scan(next(license_scan.slices(pa.array([text]))))
        for h in hits[0]:
            want = max(len(pairs(text) & pairs(x)) / len(pairs(x)) for x in license_scan.TEMPLATES[h[2]])
            assert abs(h[4] - want) < 1e-9 and h[5] == (want >= license_scan.MIN_COVER)


def test_near_dedup(docs, none, rows):
    want = near_classes(rows)
    out = got(near_dedup.near_duplicates(docs))
    assert len(out) == len(rows)
    for r in out:
        if r["doc_id"] is None:
            assert r["component_id"] == want[rows[7][0]][1] and not r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    assert got(near_dedup.near_duplicates(none)) == []


def test_near_dedup_family(spark):
    """Variants of one text at many distances: links beside the hub's class are found."""
    r = random.Random(9)
    base = [f"t{r.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(90):
        words = base.copy()
        for _ in range(r.choice([1, 2, 3, 4, 5, 6, 7])):
            words[r.randrange(150)] = f"n{r.randrange(10**6)}"
        rows.append((i, " ".join(words), "a"))
        if i % 7 == 0:
            rows.append((500 + i, " ".join(words[:-2]), "a"))
    want = near_classes(rows)
    out = {x["doc_id"]: x["component_id"] for x in got(near_dedup.near_duplicates(documents(spark, rows)))}
    assert out == {i: c for i, (_, c) in want.items()} and len(set(out.values())) > 1


@pytest.mark.parametrize("block,shingles_each", [(1024, 1_000_000), (8, 500)])
def test_near_dedup_blocks(spark, monkeypatch, block, shingles_each):
    """Tiles of few members and of many give the same links."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", shingles_each)
    r = random.Random(2)
    base = [f"t{r.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(150):
        words = base.copy()
        for _ in range(r.choice([2, 4, 5, 6])):
            words[r.randrange(120)] = f"n{r.randrange(10**6)}"
        rows.append((i, " ".join(words[: r.choice([120, 110, 100])]), "a"))
    want = near_classes(rows)
    out = {x["doc_id"]: x["component_id"] for x in got(near_dedup.near_duplicates(documents(spark, rows)))}
    assert out == {i: c for i, (_, c) in want.items()} and 1 < len(set(out.values())) < 150


def test_signatures_agree_above_the_cut():
    """Pairs of similarity 0.75 or more, small sets too, agree in far more bins than candidates must."""
    g = np.random.default_rng(7)
    for n in (4, 7, 20, 90, 400, 3000):
        for _ in range(40):
            common = g.integers(0, 2**63, n, dtype=np.uint64)
            x, y = (np.unique(np.append(common, g.integers(0, 2**63, max(0, n // 7), dtype=np.uint64))) for _ in range(2))
            agree = (near_dedup.sketch_of(near_dedup.signature(x)) == near_dedup.sketch_of(near_dedup.signature(y))).sum()
            assert not near_dedup._similar(x, y) or agree >= near_dedup.AGREE


def test_similar_matrix():
    g = np.random.default_rng(3)
    sets = [np.unique(g.integers(0, 60, n).astype(np.uint64)) for n in (5, 40, 80, 200, 300, 1)]
    m = near_dedup._similar_matrix(sets, sets, width=7)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            assert m[i, j] == near_dedup._similar(x, y)


def test_very_long_texts(spark):
    """One text of a megabyte and more beside small ones, in every operator that reads texts."""
    r = random.Random(1)
    words = [f"word{r.randrange(10**5)}" for _ in range(150_000)]
    long = " ".join(words)
    changed = " ".join(words[:-3])
    rows = [(1, long, "a"), (2, long.replace(" ", "  "), "a"), (3, changed, "b"), (4, "short text of a few words only in here now ok", "b"), (5, "x" * 1_000_000, None)]
    docs = documents(spark, rows)
    dedup = {x["doc_id"]: x["keep_id"] for x in got(exact_dedup.exact_duplicates(docs))}
    assert dedup == {1: 2, 2: 2, 3: 3, 4: 4, 5: 5}
    plan = {x["doc_id"]: x["size"] for x in got(mixing.mix_plan(docs))}
    assert plan == {1: 150_000, 2: 150_000, 3: 149_997, 4: 11, 5: 1}
    judged = {x["doc_id"]: x["kept"] for x in got(quality_rules.judge_documents(docs))}
    assert judged == {1: True, 2: True, 3: True, 4: True, 5: False}
    near = {x["doc_id"]: x["component_id"] for x in got(near_dedup.near_duplicates(docs))}
    assert near == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5} and similar(shingles(long), shingles(changed))
    assert all(x["n_dropped"] == 0 and x["text"] == t for x, (_, t, _) in zip(sorted(got(line_dedup.dedup_lines(docs)), key=lambda x: x["doc_id"]), rows, strict=True))
    model = toxicity.Model(toxicity.buckets_of_words(["vile"]), np.array([9.0]), -3.0)
    assert [x["predicted"] for x in got(toxicity.score_documents(documents(spark, [(1, long + " vile", "a")]), model))] == [1]
    urls = spark.createDataFrame([(1, "http://" + "a." * 20_000 + "com/en/" + "x" * 100_000)], "page_id long, url string")
    assert [x["rule"] for x in got(url_filter.judge_urls(urls, url_filter.rules_frame(spark)))] == ["com/en/"]


def test_line_digest_matches_query(spark, rows):
    """Digests that the query derives are of the texts that the operator returns."""
    out = got(line_dedup.dedup_lines(documents(spark, rows)).select("text", F.sha2("text", 256).alias("d")))
    assert all(x["d"] == digest(x["text"].encode()) for x in out)
