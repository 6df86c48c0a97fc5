"""Every catalog query with an SQL twin agrees with DuckDB on the smallest tables."""

import hashlib
import os

import duckdb
import pytest

import __spark_entry__
from strandweave import catalog, registry

DIR = "/root/testdata/sf0.001"


def _rows(table):
    def norm(v):
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    cols = sorted(table.column_names)
    return cols, sorted(tuple(norm(v) for v in row) for row in zip(*[table[c].to_pylist() for c in cols], strict=True))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, db, name):
    got = catalog.queries()[name](spark, DIR).toArrow()
    want = db.execute(catalog.oracle_sql()[name]).to_arrow_table()
    assert _rows(got) == _rows(want)


@pytest.mark.parametrize("name", ["channel_nanopore", "channel_mesa", "channel_markov", "channel_burst"])
def test_edits_rebuild_reads(spark, name):
    rows = catalog.queries()[name](spark, DIR).toArrow()
    assert all(rows["reconciled"].to_pylist()) and rows.num_rows


def test_flagship_is_noisy(spark):
    """Reads differ from their strands and from each other, and still decode."""
    from strandweave.operators import channels, codecs

    strand = codecs.encode_max_density(catalog.documents(spark, DIR), catalog.PLAN).limit(500)
    hit = channels.channel_indel(channels.copies(strand, 10, 1, 51), *catalog._NOISE, 53)
    kinds = {r["mode"] for r in hit.selectExpr("explode(mutated.edits) e").select("e.mode").distinct().collect()}
    assert kinds == {"insertion", "deletion", "mismatch"}
    assert hit.selectExpr("mutated.seq <> dna as hit").groupBy("hit").count().filter("hit").first()["count"] > 1000


def test_partitions_do_not_matter(spark):
    from strandweave.operators import channels

    base = catalog.customers(spark, DIR)
    sets = [sorted(channels.channel_indel(base.repartition(n), 0.02, 0.02, 0.02, 7).select("payload_id", "mutated.seq").toArrow().to_pylist(), key=str) for n in (1, 5)]
    assert sets[0] == sets[1]


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and all(r["success_rate"] > 0.9 for r in rows)


def test_registry(spark):
    with pytest.raises(ValueError):
        registry.method("storage", "biogene")(catalog.customers(spark, DIR), years=-1)
    with pytest.raises(ValueError):
        registry.method("storage", "nowhere")
    kept = registry.method("storage", "permafrost")(catalog.customers(spark, DIR), years=0.0)
    assert kept.count() == catalog.customers(spark, DIR).count()


def test_files(spark, tmp_path):
    from strandweave.sources import files

    df = spark.createDataFrame([("a", "ACGT"), ("b", "GGTT")], "name string, seq string")
    files.write_fasta(df, str(tmp_path / "f"))
    back = files.read_fasta(spark, str(tmp_path / "f"))
    assert sorted(map(tuple, back.select("name", "seq").collect())) == [("a", "ACGT"), ("b", "GGTT")]
    (tmp_path / "lib.csv").write_bytes(b"ACGTACGT\r\nGGGGCCCC\r\n")
    assert [r["oligo"] for r in files.read_library(spark, str(tmp_path / "lib.csv")).orderBy("idx").collect()] == ["ACGTACGT", "GGGGCCCC"]
    assert files.read_profiles(spark).count() == 16


def test_stream(spark, tmp_path):
    from strandweave.streaming import reads

    src = spark.createDataFrame([("2024-01-01 00:00:01", "ACGT"), ("2024-01-01 00:00:02", "ACGA"), ("2024-01-01 00:00:03", "ACGA")], "ts string, seq string").selectExpr("cast(ts as timestamp) ts", "seq")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = reads.base_votes(stream, 2).writeStream.outputMode("complete").format("memory").queryName("votes").start()
    q.processAllAvailable()
    q.stop()
    assert [r["seq"] for r in reads.consensus_of(spark.table("votes")).collect()] == ["ACGA"]


@pytest.mark.parametrize("name", ["dna_encode_no_homopolymer", "dna_decode_no_homopolymer", "dna_encode_church", "dna_decode_church", "segment_redundancy_xor", "segment_repair", "roundtrip_rs", "roundtrip_lt"])
def test_codecs_run_on_documents(spark, name):
    files = {f.rsplit("/", 1)[-1] for f in catalog.queries()[name](spark, DIR).inputFiles()}
    assert files == {"documents.parquet"} and " documents " in catalog.oracle_sql()[name]


def test_pools_are_whole(spark, tmp_path):
    """No copy is dropped: each chain's symbols on both strands add up to what its pool began with. Ten meetings an oligo."""
    from strandweave.operators import assembly

    spark.createDataFrame([(f"Brand#1{i % 2}",) for i in range(130)], "p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    symbols = {10: 0, 11: 0}
    for r in catalog.queries()["pool_hybridise"](spark, str(tmp_path)).collect():
        symbols[r["pool_id"]] += r["n"] * sum(s != "" for s in [*r["fwd"], *r["rev"]])
    assert symbols == {10: 65 * 9, 11: 65 * 9}
    pools = spark.createDataFrame([(1, ["a", "b"], ["a*", ""], 300), (1, ["", "c"], ["b*", "c*"], 300)], "pool_id long, fwd array<string>, rev array<string>, n long")
    left = [sum(r["n"] for r in assembly.hybridise(pools, *steps, seed=3).collect()) for steps in ((), (6000,), (60,))]
    assert left[0] == left[1] < left[2]


def test_guess_and_check_queries_are_whole(spark, tmp_path):
    """All blocks of the conversations count, and strands lose and gain bases."""
    spark.createDataFrame([(i, t, "user", f"turn {t} of talk {i} " * 6) for i in range(3) for t in range(4)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    blocks = sum(-(-len(f"turn {t} of talk {i} " * 6) // 21) for i in range(3) for t in range(4))
    d = str(tmp_path)
    assert {r[0] for r in catalog._gc_damaged(spark, d).selectExpr("length(dna)").collect()} == {103, 104, 105}
    back = catalog.queries()["roundtrip_gcplus"](spark, d).collect()
    assert len(back) == 12 and all(r["ok"] for r in back)
    rates = catalog.queries()["fer_gcplus"](spark, d).collect()
    assert len(rates) == 3 and all(r["n"] == blocks for r in rates)


def _turns(spark, d):
    """Few turns, of which two hold the same text."""
    rows = [(1, 0, "user", "a b" * 20), (1, 1, "user", "a b" * 20), (2, 0, "user", "é" * 30), (2, 1, "user", ""), (3, 0, "user", "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")


def test_frame_errors_decode_once(spark, tmp_path):
    """Strands are dealt, made, changed and decoded once a rate, and not joined with what decoding gives without errors."""
    _turns(spark, tmp_path)
    rates = catalog.queries()["fer_gcplus"](spark, str(tmp_path))
    plan = rates._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 9 and plan.count("REPARTITION_BY_NUM") == 3 and "Join" not in plan
    assert all(r["n"] == 10 and abs(r["success"] + r["failed"] + r["undetected"] - 1) < 1e-9 for r in rates.collect())


def test_guess_and_check_meets_once(spark, tmp_path):
    """Turns are dealt, their blocks meet in one more exchange, and no join brings their sizes."""
    _turns(spark, tmp_path)
    back = catalog.queries()["roundtrip_gcplus"](spark, str(tmp_path))
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") == 2 and "REPARTITION_BY_NUM" in plan and "Join" not in plan
    want = {p: hashlib.md5(t.encode()).hexdigest() for p, t in ((1000, "a b" * 20), (1001, "a b" * 20), (2000, "é" * 30), (3000, "x"))}
    assert {r["payload_id"]: r["bytes_md5"] for r in back.collect() if r["ok"]} == want


def test_tied_guesses_are_settled(spark, tmp_path):
    """Strands that are one edit from two codewords, the first of which is wrong: the turn's seal tells."""
    rows = [(25587, 0, "user", "x" * 21 * 13 + "edti a. Eninor reenti"), (16660, 1, "user", "x" * 21 * 18 + "sch ver das der schke" + "y" * 30)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    back = catalog.queries()["roundtrip_gcplus"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in back} == {(c * 1000 + t, hashlib.md5(text.encode()).hexdigest(), True) for c, t, _, text in rows}


@pytest.mark.parametrize("bits", [1, 2])
@pytest.mark.parametrize("ratio", [1.0, 0.8])
def test_fountains_by_whole_payloads(spark, bits, ratio):
    """Symbols need no exchange to be made, and are peeled before they cross one; scattered, lost, doubled and spoilt ones give the same contents."""
    from pyspark.sql import functions as F

    from strandweave.operators import codecs
    from strandweave.plans import codec_plan

    plan = codec_plan.max_density(200, 14, ratio, (20, 10)) if bits == 2 else codec_plan.no_homopolymer(400, 30, ratio, (40, 20))
    encode, decode = (codecs.encode_max_density, codecs.decode_max_density) if bits == 2 else (codecs.encode_no_homopolymer, codecs.decode_no_homopolymer)
    texts = {1: b"x", 2: bytes(range(256)) * 5, 3: b"", 4: None, 5: "é".encode() * 37, 6: bytes(plan.payload_bits // 8 * 3), 7: b"long " * 3000}
    payload = spark.createDataFrame(list(texts.items()), "payload_id long, content binary")
    strand = encode(payload, plan, 5.0)
    want = {i: t for i, t in texts.items() if t}
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (strand, decode(strand, plan))]
    assert "Exchange" not in plans[0] and plans[1].count("Exchange") == 1 and "FlatMapGroups" not in plans[1]
    strand = strand.localCheckpoint()
    sizes = {r["payload_id"]: r["count"] for r in strand.groupBy("payload_id").count().collect()}
    assert sizes == {i: 6 * -(-len(t) * 8 // plan.payload_bits) for i, t in want.items()}
    assert strand.filter(~F.col("dna").rlike(f"^[ACGT]{{{plan.length}}}$")).isEmpty()
    lost = strand.filter((F.col("payload_id") < 5) | (F.col("strand_idx") % 7 != 3))
    # No header tells this number of words; and strands of another length or with other letters don't count.
    spoilt = strand.filter("strand_idx % 5 = 0").withColumn("dna", F.overlay("dna", F.reverse(F.substring("dna", plan.barcode + 1, plan.lt_header)), F.lit(plan.barcode + 1)))
    odd = strand.selectExpr("payload_id", "strand_idx", "substring(dna, 2) AS dna").unionByName(strand.selectExpr("payload_id", "strand_idx", "concat('N', substring(dna, 2)) AS dna"))
    for given in (strand, lost.unionByName(strand.sample(0.3, 3)).repartition(3, F.rand(5)), lost.unionByName(odd).orderBy("strand_idx"), lost.unionByName(spoilt).coalesce(1)):
        back = {r["payload_id"]: r for r in decode(given, plan).collect()}
        assert {i: bytes(r["content"]) for i, r in back.items()} == want
        assert all(r["n_missing"] == r["n_failed"] == 0 and r["n_strands"] * 6 == sizes[i] for i, r in back.items())
    # With too few symbols a payload is not whole.
    few = {r["payload_id"]: r for r in decode(strand.filter("payload_id <> 7 or strand_idx < 200"), plan).collect()}
    assert few[7]["content"] is None and few[7]["n_missing"] > 0 and few[7]["n_strands"] + few[7]["n_missing"] == sizes[7] // 6


def test_noisy_reads_are_made_once(spark):
    """Sequences are those of the channel, made once though a filter looks at them; consensus counts equal reads before one exchange and votes as by rows."""
    import random

    from pyspark.sql import functions as F

    from strandweave.operators import channels, reads

    strand = channels.copies(catalog.customers(spark, DIR).drop("copy_no"), 4, 1, 5)
    made = channels.indel_seqs(strand, 0.02, 0.02, 0.03, 7).filter(F.char_length("seq") == 72)
    # The names' bases are the other.
    assert made._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 2
    key = ["payload_id", "copy_no", "seq"]
    want = channels.channel_indel(strand, 0.02, 0.02, 0.03, 7).withColumn("seq", F.col("mutated.seq")).filter(F.char_length("seq") == 72)
    assert sorted(map(tuple, made.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))
    r = random.Random(3)
    rows = [(r.choice((1, 2, None)), r.choice("ab"), "".join(r.choices("ACGTN", k=r.choice((3, 4)))) if r.random() < 0.9 else None, i) for i in range(400)]
    given = spark.createDataFrame(rows, "p long, q string, seq string, ord long").repartition(3)
    called = reads.consensus(given, ["p", "q"], most=400)
    assert called._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2  # one is the test's own
    votes: dict = {}
    for p, q, seq, _ in rows:
        votes.setdefault((p, q), []).append(seq or "")
    best = lambda col: max("ACGT", key=lambda b: (col.count(b), -col.index(b) if b in col else -len(col)))
    rule = {k: ("".join((lambda c: best(c) if set(c) & set("ACGT") else "A")([s[i] for s in v if len(s) > i]) for i in range(max(map(len, v)))), len(v)) for k, v in votes.items()}
    assert {(x["p"], x["q"]): (x["seq"], x["n_reads"]) for x in called.collect()} == rule
