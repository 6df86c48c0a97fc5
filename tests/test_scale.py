"""Kernels that stand for per-base or per-row work, each held against its plain form, and bounds on what they hold at once."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandweave import catalog
from strandweave.functions import digests, kernels, rng
from strandweave.operators import channels, reads


def test_digests_of_many_keys():
    """Sizes on both sides of one block, numbers of one to five digits."""
    r = random.Random(1)
    prefixes = [b"x" * r.randrange(60) for _ in range(60)]
    counts = np.array([r.choice([0, 1, 9, 10, 120]) for _ in prefixes])
    counts[:2] = 11_000, 1_000
    want = [digests.head(p + b"|%d" % i) for p, n in zip(prefixes, counts, strict=True) for i in range(1, n + 1)]
    assert digests.heads(prefixes, counts).tolist() == want


@pytest.mark.parametrize("distinct", [False, True])
def test_substitutions_are_the_expressions(spark, distinct):
    """channel_iid's reads base by base: the kernel draws what rng.uniform draws, for odd strands and keys too."""
    rows = [(i, 0, i % 3, s) for i, s in enumerate([None, "", "A", "ACGT" * 40, "NNXacgt", "AéCG漢T" * 9, "T" * 1200, "GATTACA" * 20])] + [(None, None, None, "ACGT" * 30)]
    reads = spark.createDataFrame(rows, "payload_id long, strand_idx int, copy_no int, dna string")
    key = [F.col(c) for c in ("payload_id", "strand_idx", "copy_no")]

    def change(b, i):
        u = rng.uniform(5, "base", *key, i)
        other = F.replace(F.lit("ACGT"), b, F.lit("")) if distinct else F.lit("ACGT")
        return F.when(rng.uniform(5, "hit", *key, i) < 0.3, F.substring(other, (F.floor(u * (3 if distinct else 4)) + 1).cast("int"), F.lit(1))).otherwise(b)

    want = reads.withColumn("read", channels._per_base(F.col("dna"), change)).withColumn("n_changed", F.size(channels.bits.diff_positions(F.col("dna"), F.col("read"))))
    got = channels.substitute_iid(reads, 0.3, 5, distinct)
    assert "transform" not in got._jdf.queryExecution().optimizedPlan().toString(), "an expression a base"
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def _columns(seqs):
    return kernels.flat(pa.array(seqs))[:2]


def test_markov_of_a_batch():
    """Rates of the events by context and event before, edits that rebuild reads, independence of how reads are batched."""
    r = random.Random(4)
    seqs = ["".join(r.choice("ACGT") for _ in range(r.randint(0, 200))) for _ in range(600)]
    keys = channels._mixed(np.arange(600, dtype=np.uint64))
    table = {("", ""): (0.02, 0.03, 0.05, 0.9), ("ACG", "Tra"): (0.0, 1.0, 0.0, 0.0), ("", "Del"): (0.0, 0.0, 0.0, 1.0)}
    swap = {"A": (0, 1, 0, 0)}
    data, bounds = _columns(seqs)
    out, ends, edits = channels.markov_batch(data, bounds, keys, table, swap, 3)
    texts, n = kernels.column_of(out, ends, None, pa.string()).to_pylist(), {"insertion": 0, "deletion": 0, "mismatch": 0}
    for seq, text, own in zip(seqs, texts, edits.to_pylist(), strict=True):
        rebuilt, at, gone = "", 0, set()
        for e in own:
            rebuilt += seq[at : e["pos"]] + e["mod"]
            at = e["pos"] + (e["mode"] != "insertion")
            n[e["mode"]] += seq[e["pos"] - 1 : e["pos"] + 2] != "ACG"
            assert e["mode"] != "mismatch" or e["mod"] == "C" if e["orig"] == "A" else e["mod"] != (e["orig"] or "-")
            gone |= {e["pos"]} if e["mode"] == "deletion" else set()
        assert rebuilt + seq[at:] == text and not {i + 1 for i in gone} & gone
        edited = {e["pos"] for e in own}
        assert all(i in gone for i in range(1, len(seq) - 1) if seq[i - 1 : i + 2] == "ACG" and not {i - 1, i} & edited)
    total = sum(map(len, seqs))
    assert all(abs(n[k] / total - p) < 0.008 for k, p in (("insertion", 0.02), ("deletion", 0.03), ("mismatch", 0.05)))
    d2, b2 = _columns(seqs[100:])
    assert kernels.column_of(*channels.markov_batch(d2, b2, keys[100:], table, swap, 3)[:2], None, pa.string()).to_pylist() == texts[100:]


_EDITED = [
    ("ACGTA", [("insertion", 1, "", "T"), ("insertion", 1, "", "G"), ("deletion", 1, "C", "")]), ("ACGTA", [("mismatch", 4, "A", "C"), ("insertion", 0, "", "T"), ("mismatch", 4, "A", "G")]),
    ("éCG", [("deletion", 0, "é", ""), ("insertion", 9, "", "A")]), ("AA", []), ("", []), (None, []), ("ACGT", None),
]


def _edited(spark, rows):
    return spark.createDataFrame([(s, (None, e)) for s, e in rows], "dna string, mutated struct<seq:string,edits:array<struct<mode:string,pos:int,orig:string,mod:string>>>")


def test_edits_are_applied(spark):
    from strandweave.operators import qc

    found = qc.apply_edits(_edited(spark, _EDITED))
    assert [x.rebuilt for x in found.collect()] == ["ATGGTA", "TACGTC", "CG", "AA", "", "", ""]
    assert "filter(" not in found._jdf.queryExecution().optimizedPlan().toString(), "a look through all edits for each base"


def test_estimate_counts_events(spark):
    """Odd letters, several edits at a place (the first counts), no edits; and no row a base."""
    for rows in (_EDITED, [x for x in _EDITED if "é" not in (x[0] or "")]):
        want = {}
        for s, e in rows:
            for i in range(len(s or "")):
                event = next((m for m, p, *_ in e or [] if p == i), "transmission")
                want[s[max(0, i - 1) : i + 2], event] = want.get((s[max(0, i - 1) : i + 2], event), 0) + 1
        got = channels.estimate_channel(_edited(spark, rows))
        assert {(x.context, x.event): x.n for x in got.collect()} == want
        assert "explode" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_kernels_take_parts(monkeypatch):
    """However large a batch is, a kernel holds a part of it at a time; rows keep their places."""
    monkeypatch.setattr(kernels, "PART", 100)
    column = pa.array([b"x" * n if n % 7 else None for n in range(60)] + [b"y" * 1000, b""], pa.binary())
    parts = list(kernels.sliced(column))
    assert pa.concat_arrays(parts).equals(column) and len(parts) > 10
    assert all(len(p) == 1 or sum(len(x or b"") for x in p.to_pylist()) <= 100 for p in parts)
    assert len(list(kernels.sliced(column.slice(0, 0)))) == 1


def test_bits_of_many_rows(spark, monkeypatch):
    rows = spark.createDataFrame([(i, bytearray(b"ab\xff" * (i % 50000))) for i in (0, 1, 49_999, 49_998, 3)] + [(9, None)], "i int, content binary")
    back = rows.select("i", (kernels.bits_to_bytes(kernels.bytes_to_bits(F.col("content"))) == F.col("content")).alias("same"))
    assert sorted(map(tuple, back.collect()), key=str) == [(0, True), (1, True), (3, True), (49998, True), (49999, True), (9, None)]


def test_qualities_are_not_broadcast(spark):
    """Gaps, repeated reads and reads without a profile; the profile's size isn't taken from the file's."""
    from strandweave.operators import qc

    reads = spark.createDataFrame([(1, "ACGT"), (2, "AC"), (3, ""), (4, "ACG")], "read_id long, seq string")
    profile = spark.createDataFrame([(1, 1, 0.1), (1, 3, 1.0), (2, 0, 0.01), (2, 1, 0.001), (4, 2, 0.5), (4, 0, 0.5), (4, 1, 0.1)], "read_id long, pos int, prob double")
    got = qc.fastq_quality(reads, profile)
    assert {x.read_id: x.quality for x in got.collect()} == {1: "I+I!", 2: "5?", 3: "", 4: "$+$"}
    plan = catalog.queries()["fastq_quality"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("nsym,m,k", [(1, 8, 9), (3, 8, 21), (20, 8, 235), (8, 14, 30)])
def test_words_are_corrected_together(nsym, m, k, monkeypatch):
    """As one by one, for words with too many errors too; none is corrected alone."""
    from strandweave.ecc.reed_solomon import Code

    g, c = np.random.default_rng(nsym), Code(nsym, m)
    words = c.encode(g.integers(0, 1 << m, (200, k)))
    for i in range(200):
        places = g.choice(k + nsym, int(g.integers(0, nsym + 2)), replace=False)
        words[i, places] ^= g.integers(1, 1 << m, len(places))
    want = [c.correct(w) for w in words]
    monkeypatch.setattr(Code, "correct", None)
    got, ok = c.decode(words)
    assert ok.tolist() == [w is not None for w in want] and 0 < ok.sum() < 200
    assert (got == np.array([x if w is None else w for x, w in zip(words, want, strict=True)])[:, :k]).all()


def test_columns_of_words():
    from strandweave.ecc import reed_solomon as rs

    r = random.Random(6)
    rows = [None, b"", *[r.randbytes(r.choice([1, 5, 234, 235, 236, 470, 1000])) for _ in range(40)]]
    coded = rs.protected(pa.array(rows, pa.binary()), 20).to_pylist()
    assert coded == [None if x is None else rs.protect(x, 20) for x in rows]
    hit = [x if not x else bytes(b ^ 255 if i % r.choice([9, 30, 50]) == 0 else b for i, b in enumerate(x))[: r.choice([10, 300, 5000])] for x in coded]
    want = [(None, False) if x is None else rs.restore(x, 20) for x in hit]
    assert [(x["content"], x["ok"]) for x in rs.restored(pa.array(hit, pa.binary()), 20).to_pylist()] == want


def _pieces(content, k, index_bits, redundancy):
    """Segments by the definition."""
    text = "".join(f"{b:08b}" for b in content)
    parts = [text[i : i + k].ljust(k, "0") for i in range(0, len(text), k)]
    out = [(i // 2 * 3 + i % 2 if redundancy else i, p) for i, p in enumerate(parts)]
    for i in range(0, len(parts), 2) if redundancy else ():
        other = parts[i + 1] if i + 1 < len(parts) else "0" * k
        out.append((i // 2 * 3 + 2, "".join("01"[x != y] for x, y in zip(parts[i], other, strict=True))))
    return sorted((n, f"{n:0{index_bits}b}" + p) for n, p in out)


def test_segments_cross_packed(spark):
    """Segments as defined, repairs and losses counted, duplicates and strays; no text of bits is shuffled."""
    from strandweave.operators import codecs

    r = random.Random(3)
    contents = {i: r.randbytes(n) for i, n in enumerate([0, 1, 4, 5, 9, 50, 51, 200, 333])}
    payload = spark.createDataFrame([(i, bytearray(c)) for i, c in contents.items()] + [(99, None)], "payload_id long, content binary")
    for redundancy in (False, True):
        s = codecs.segments(payload, 37, 10, redundancy)
        assert sorted(map(tuple, s.collect())) == [(i, *x) for i, c in contents.items() for x in _pieces(c, 27, 10, redundancy)]
        sizes = payload.filter("octet_length(content) > 0").selectExpr("payload_id", "octet_length(content) * 8 AS n_bits")
        gone = F.pmod(F.xxhash64("payload_id", F.floor(F.col("seg_idx") / 3)), F.lit(3)) == F.col("seg_idx") % 3
        kept = s.filter(~gone)
        lost = s.filter(gone)
        for capacity in (None, 37):
            back = codecs.repair_segments(kept.unionByName(kept), sizes, 10, redundancy, capacity)
            got = {x.payload_id: x for x in back.collect()}
            assert set(got) == set(contents) - {0}
            n_lost = {i: 0 for i in contents} | {x.payload_id: x["count"] for x in lost.groupBy("payload_id").count().collect()}
            n_data = {i: 0 for i in contents} | {x.payload_id: x["count"] for x in lost.filter("seg_idx % 3 < 2").groupBy("payload_id").count().collect()}
            for i, x in got.items():
                text = "".join(f"{b:08b}" for b in contents[i])
                assert (x.n_lost, x.n_repaired) == ((0, n_data[i]) if redundancy else (n_lost[i], 0))
                assert len(x.bits) == len(text) and (x.bits == text or not redundancy and n_lost[i])
    plan = back._jdf.queryExecution().optimizedPlan().toString()
    assert "repeat" not in plan and "collect_list" not in plan and "max(" not in plan


def test_trits_by_batches(spark):
    """Against the definitions row by row: all bytes, repeated bases, odd ends, nulls; as whole batches."""
    from strandweave.operators import codecs

    def trits(data):
        out = ""
        for b in data:
            n = b if b <= 235 else b + 472
            t = ""
            while n:
                n, t = n // 3, str(n % 3) + t
            out += t.rjust(5, "0")
        return out

    r = random.Random(7)
    rows = [None, b"", bytes(range(256)), b"\xff" * 9, *[r.randbytes(r.randrange(60)) for _ in range(40)]]
    text = lambda fn, column, kind: kernels.column_of(*fn(*kernels.flat(pa.array(column))), kind).to_pylist()
    coded = text(codecs._trits, rows, pa.string())
    assert coded == [None if x is None else trits(x) for x in rows]
    assert text(codecs._trits_read, [None if t is None else t + "2222"[: i % 5] for i, t in enumerate(coded)], pa.binary()) == rows
    strands = text(codecs._rotated, coded, pa.string())
    for t, s in zip(coded, strands, strict=True):
        place, want = 0, ""
        for c in t or "":
            place = (place + int(c) + 1) % 4
            want += "ACGT"[place]
        assert (s or "") == want and (t is None) == (s is None)
    assert text(codecs._unrotated, strands, pa.string()) == [t or None for t in coded]
    assert text(codecs._unrotated, ["CC", "AC", "CA", ""], pa.string()) == [None, None, "02", None]
    plan = codecs.encode_goldman(spark.createDataFrame([(1, bytearray(b"abc" * 50))], "payload_id long, content binary"))._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan, "an expression a base"


def test_alternating_by_batches(spark):
    from strandweave.functions import nt

    rows = spark.createDataFrame([(0, "0110"), (1, "1"), (2, ""), (3, None), (4, "10" * 50 + "0")], "i int, bits string")
    got = rows.select("i", nt.alternating(F.col("bits")).alias("dna"))
    assert dict(map(tuple, got.collect())) == {0: "TAGC", 1: "G", 2: "", 3: None, 4: "GC" * 50 + "T"}
    assert "replace(" not in got._jdf.queryExecution().optimizedPlan().toString(), "a pass for each digit"


def test_consensus_of_known_groups_makes_reads_once(spark):
    """With a bound on its groups no group is counted before the vote; the vote is the same."""
    made = spark.sparkContext.accumulator(0)
    source = spark.range(60).selectExpr("id % 6 AS payload_id", "substr('ACGTACGT', cast(id % 2 AS int) + 1, 4) AS seq", "id AS ord")

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    seen = source.mapInArrow(count, source.schema)
    want = {(r["payload_id"], r["seq"], r["n_reads"]) for r in reads.consensus(seen, ["payload_id"]).collect()}
    assert made.value == 120
    got = {(r["payload_id"], r["seq"], r["n_reads"]) for r in reads.consensus(seen, ["payload_id"], most=60).collect()}
    assert made.value == 180 and got == want and len(got) == 6
    normal = channels.copies(spark.range(3000).selectExpr("id AS payload_id", "0 AS strand_idx", "'A' AS dna"), 10, 1, 51)
    assert 12 < normal.selectExpr("max(copy_no) + 1").first()[0] <= channels.most_copies(10, 1) == 16
