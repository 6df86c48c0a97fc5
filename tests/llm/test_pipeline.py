import base64
import struct
from collections import Counter

import pytest

import corpus_pipeline
from strandweave.llm import near_dedup, queries

from .helpers import bad_host, corpus, digest, documents, line_stage, mix_times, near_stage, quality_stage


@pytest.fixture(scope="module")
def encode():
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def rows_of(df):
    return Counter((r["doc_id"], r["text"], r["source"]) for r in df.select("doc_id", "text", "source").collect())


def test_stages_against_brute_force(spark, tmp_path, encode):
    """Each stage on what the one before kept, and the whole run."""
    rows = bad_host(corpus())
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    brute = {"quality_rules": quality_stage, "line_dedup": line_stage, "near_dedup": near_stage, "source_mixing": lambda x: [r for r, n in zip(x, mix_times(x), strict=True) for _ in range(n)]}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"s{i}"))
        out = spark.read.parquet(str(tmp_path / f"s{i}"))
        if name in brute:
            before, rows = rows, brute[name](rows)
            assert out.columns == docs.columns and rows_of(out) == Counter(rows), name
            assert rows and Counter(rows) != Counter(before), name
        docs = out
    want = Counter()
    for doc_id, text, source in rows:
        ids = encode(text or "")
        want[doc_id, source, len(ids), struct.pack(f"<{len(ids)}I", *ids), digest((text or "").encode())] += 1
    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["source"], r["n_tokens"], bytes(r["ids"]), r["decoded_sha256"]) for r in run) == want


def test_lengths_follow_texts(spark, tmp_path):
    docs = documents(spark, corpus())
    out = corpus_pipeline.lines(spark, docs, str(tmp_path)).collect()
    assert all(r["n_chars"] == len(r["text"]) for r in out)


def test_empty(spark, tmp_path):
    documents(spark, corpus()).filter("false").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = queries.queries()
    assert "pipeline" in names and len([n for n in names if n.startswith("op")]) == 10
    assert set(queries.oracle_sql()) <= set(names)


def test_near_stage_decides_by_row(spark):
    """Null and repeated ids: a copied text goes, unique ones of the same id stay."""
    words = lambda seed: " ".join(f"w{seed * 100 + i}" for i in range(30))
    rows = [(3, words(0), "a"), (4, words(1), "a"), (5, words(0), "a"), (5, words(2), "a"), (None, words(1), "a"), (None, words(3), "b"), (None, words(4), None), (None, None, "a"), (6, None, "a")]
    kept = near_dedup.keep_one(documents(spark, rows))
    want = [rows[i] for i in (0, 1, 3, 5, 6, 7, 8)]
    assert rows_of(kept) == Counter(want) == Counter(near_stage(rows))
