"""Drawn data, weighted sampling, class repair, positional libraries and timed sweeps on small fixtures."""

import pytest
from pyspark.sql import functions as F

from strandweave import scratch
from strandweave.functions import bits
from strandweave.operators import assembly, channels, experiments, random_data, reads


def test_running_total(spark):
    rows = spark.createDataFrame([(i, i % 5) for i in range(1000)], "k long, w long").repartition(7)
    got = {r["k"]: r["lo"] for r in scratch.running_total(rows, "lo", F.col("w"), F.col("k")).collect()}
    total = 0
    for k in range(1000):
        assert got[k] == total
        total += k % 5


def test_weighted_sampling_is_exact_and_bounded(spark):
    """One strand holds a third of all weight; strands without weight are never drawn; reruns agree under any partitioning."""
    rows = [(i, 0, "ACGT"[i % 4] * 8, 1 if i else 500) for i in range(1001)] + [(2000, 0, "AAAA", 0), (2001, 0, "CCCC", None)]
    strand = spark.createDataFrame(rows, "payload_id long, strand_idx int, dna string, w long")
    sets = [sorted(channels.sample_weighted(strand.repartition(n), 3.0, F.col("w"), 0.5, 4).select("draw", "payload_id", "read").toPandas().itertuples(index=False, name=None)) for n in (1, 6)]
    assert sets[0] == sets[1] and [r[0] for r in sets[0]] == list(range(3 * 1003))
    hot = sum(r[1] == 0 for r in sets[0]) / len(sets[0])
    assert 0.29 < hot < 0.38 and not {r[1] for r in sets[0]} & {2000, 2001}
    assert channels.sample_weighted(strand.limit(0), 3.0).count() == 0


def test_repair_classes(spark):
    whole = "TAGCTCGA" * 3
    cases = [whole, whole[1:], whole[:-1], whole[:10] + whole[11:], whole[:5] + whole[5] + whole[5:], "", None, "N" * 24, whole + "ACGT", "T A G C"]
    df = spark.createDataFrame([(i, 0, s) for i, s in enumerate(cases)], "payload_id long, ord long, seq string")
    got = [r["seq"] for r in reads.repair_classes(df, 24, 3).orderBy("payload_id").collect()]
    assert got[0] == whole and all(len(s) == 24 and all(c in "TGCA"[2 * (i % 2) : 2 * (i % 2) + 2] for i, c in enumerate(s)) for s in got)
    assert all(sum(a != b for a, b in zip(got[i], whole, strict=True)) <= 1 for i in (1, 2, 3)) and got[4] == whole


def test_groups_and_metrics(spark):
    df = spark.createDataFrame([(1, ["1", "2", "a"]), (2, ["1", "2", "b"]), (3, ["1", "x", "c"]), (4, ["1", None, "c"])], "i long, items array<string>")
    assert {(r["i"], r["n_group"]) for r in reads.group_by_first(df, 2).collect()} == {(1, 2), (2, 2)}
    r = spark.createDataFrame([(1, "A", 0), (1, "A", 1), (1, "C", 2)], "payload_id long, seq string, ord long")
    assert {(x["seq"], x["voted"]) for x in reads.voted_and_single(r, ["payload_id"]).collect()} == {("A", True), ("C", False)}
    empty = r.limit(0)
    assert tuple(reads.process_metrics(empty, empty, ["payload_id"]).select("n_in", "n_groups", "n_out", "n_removed").first()) == (0, 0, 0, 0)


def test_transpose_and_flatten(spark):
    df = spark.createDataFrame([([[1, 2, 3], [4, 5]],), ([],), (None,)], "m array<array<int>>")
    assert [r[0] for r in df.select(bits.transpose(F.col("m"))).collect()] == [[[1, 4], [2, 5]], [], None]
    assert df.select(bits.flatten_layers(F.col("m"), 1)).first()[0] == [1, 2, 3, 4, 5]


def test_positional_libraries(spark):
    """Against a plain reading of the rule."""
    flip = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    words = ["AACC", "AAGG", "CCAA", "CCGT", "GGAT", "GTTT", "TTGG", "TTAC", "ACAC"]
    lib = spark.createDataFrame(list(enumerate(words)), "idx long, oligo string")
    left, right = sorted({w[:2] for w in words}), sorted({w[2:] for w in words})
    want = {(i, w) for i in range(4) for w in words if not any(m in w for h in (left[i // 2], right[(i + 1) // 2]) for m in (h, flip(h)))}
    assert {(r["position"], r["oligo"]) for r in assembly.positional_libraries(lib, 4).collect()} == want
    with pytest.raises(ValueError):
        assembly.positional_libraries(lib, 40)


def test_back_translation(spark):
    motifs = {"empty": "TTTT", "a": "AC", "a*": "GT"}
    df = spark.createDataFrame([(1, ["a", "empty"], ["a*", ""]), (2, ["a"], ["a*"]), (3, ["empty", "q"], ["", "a*"])], "i long, fwd array<string>, rev array<string>")
    got = {r["i"]: (r["five_prime"], r["three_prime"]) for r in assembly.back_translate_pool(df, motifs, "empty", silent=True).collect()}
    assert got == {1: ("AC", "GT"), 3: (None, "GT")}
    assert {r["i"] for r in assembly.back_translate_pool(df, motifs, "empty", marked_only=False).collect()} == {1, 2, 3}


def test_timed_sweep(spark):
    def one(p):
        return spark.range(p["n"]) if p["n"] else spark.range(1).selectExpr("raise_error('no') AS x")

    rows = {r["name"]: r for r in experiments.timed_sweep(spark, [{"n": 3}, {"n": 0}], one).collect()}
    assert rows["n=3"]["n_rows"] == 3 and rows["n=3"]["status"] == "SUCCESS" and rows["n=0"]["status"].startswith("ERROR")
    assert all(r["seconds"] > 0 for r in rows.values())


def test_random_data(spark):
    got = random_data.texts(spark, [0, 1, 5000], 1).orderBy("file_id", "piece").collect()
    assert [(r["file_id"], len(r["text"])) for r in got] == [(0, 0), (1, 1), (2, 4096), (2, 904)]
    s = random_data.strands(spark, 300, 50, 2).agg(*[F.avg(F.length("dna") - F.length(F.replace("dna", F.lit(b), F.lit("")))).alias(b) for b in "ACGT"]).first()
    assert all(11.5 < x < 13.5 for x in s)
