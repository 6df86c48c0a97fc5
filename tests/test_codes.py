"""Codes and kernels without Spark."""

import pickle
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandweave.ecc import fountain
from strandweave.ecc.reed_solomon import Code, code, protect, restore
from strandweave.functions import kernels
from strandweave.operators import channels, gcplus, mesa, reads, word_ecc, wukong
from strandweave.plans import codec_plan
from strandweave.plans.profiles import SEQUENCING, SYNTHESIS


def test_published_vector():
    assert protect(b"hello world", 10)[11:].hex() == "ed2554c4fdfd89f3a8aa"


@pytest.mark.parametrize("m,k,nsym", [(8, 21, 3), (8, 223, 32), (14, 30, 8)])
def test_corrects_up_to_its_distance(m, k, nsym):
    g, c = np.random.default_rng(m + k), Code(nsym, m)
    for _ in range(15):
        word = c.encode(g.integers(0, 1 << m, (1, k)))
        erased = int(g.integers(0, nsym + 1))
        places = g.choice(k + nsym, erased + (nsym - erased) // 2, replace=False)
        bad = word.copy()
        bad[0, places] ^= g.integers(1, 1 << m, len(places))
        got, ok = c.decode(bad, [places[:erased].tolist()])
        assert ok[0] and (got == word[:, :k]).all()


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=600))
def test_protect_restores(data):
    assert restore(protect(data, 8), 8) == (data, True)


def test_plans():
    p = codec_plan.max_density()
    assert (p.barcode, p.header, p.message, p.payload_bits) == (75, 9, 416, 832)
    q = codec_plan.no_homopolymer()
    assert (q.barcode, q.header, q.message, q.payload_bits) == (10, 9, 481, 481)
    r = codec_plan.max_density(rs_ratio=0.8)
    assert r.header % 4 == 0 and r.message % 4 == 0 and r.payload_bits % 8 == 0
    with pytest.raises(ValueError):
        codec_plan.max_density(10)


def test_fountain_peels():
    rows = [bytes([i] * 8) for i in range(50)]
    symbols = fountain.encode_rows(rows, 150, 3)
    random.Random(1).shuffle(symbols)
    assert fountain.peel(50, symbols[:130], 3) == rows


def test_fountain_blocks_share_neighbours(monkeypatch):
    """Blocks of as many rows draw their neighbours once, whichever symbols are lost."""
    drawn, draw = [], fountain.neighbours
    monkeypatch.setattr(fountain, "neighbours", lambda *a: drawn.append(a) or draw(*a))
    r = random.Random(6)
    for lost in (3, 3, 5):
        rows = [r.randbytes(16) for _ in range(37)]
        symbols = fountain.encode_rows(rows, 37 * 4, 77)
        assert all(d == np.bitwise_xor.reduce([np.frombuffer(rows[k], np.uint8) for k in draw(37, i, 77)]).tobytes() for i, d in symbols)
        assert fountain.peel(37, [x for x in symbols if x[0] % 10 != lost], 77) == rows
    assert len(drawn) == 256


def test_guess_and_check_repairs_one_edit():
    assert gcplus.LENGTH == 104 and abs(gcplus.code_rate(parities=8) - 84 / 128) < 1e-9
    r = random.Random(5)
    for i in range(30):
        data = bytes(r.randrange(256) for _ in range(21))
        s = gcplus.encode_block(data)
        p = r.randrange(92)
        hit = [s[:p] + s[p + 1 :], s[:p] + r.choice("ACGT") + s[p:], s[:p] + ("A" if s[p] != "A" else "C") + s[p + 1 :]][i % 3]
        assert gcplus.decode_block(hit) == (data, True)


def test_guess_and_check_repairs_two_blocks():
    """Two deletions or two insertions, each in a block of its own."""
    r, right = random.Random(8), 0
    for i in range(60):
        data = bytes(r.randrange(256) for _ in range(21))
        s = gcplus.encode_block(data)
        a, b = sorted(r.sample(range(23), 2))
        p, q = 4 * a + r.randrange(4), 4 * b + r.randrange(4)
        hit = s[:p] + s[p + 1 : q] + s[q + 1 :] if i % 2 else s[:p] + r.choice("ACGT") + s[p:q] + r.choice("ACGT") + s[q:]
        right += gcplus.decode_block(hit) == (data, True)
    assert right >= 54


def test_guess_and_check_by_batches():
    """A batch gives what its strands give alone; the guess is the first of the fewest edits among all patterns, tried one by one."""
    r, f, n = random.Random(4), code(gcplus.FREE + 1), gcplus.SYMBOLS + gcplus.FREE
    strands = ["", "ACGTN" * 21, "A" * 99, "G" * 104]
    for _ in range(60):
        s = gcplus.encode_block(bytes(r.randrange(256) for _ in range(21)))
        for _ in range(r.randrange(4)):
            p = r.randrange(len(s))
            s = r.choice((s[:p] + s[p + 1 :], s[:p] + r.choice("ACGT") + s[p:], s[:p] + r.choice("ACGT") + s[p + 1 :]))
        strands.append(s)
    out, ok = gcplus.decode_rows(*kernels.flat(pa.array(strands))[:2])
    assert [(b.tobytes(), bool(k)) for b, k in zip(out, ok, strict=True)] == [gcplus.decode_block(s) for s in strands]
    letters = np.frombuffer("".join(gcplus.codebook()).encode(), np.uint8).reshape(256, -1)
    for s in strands[4:24]:
        shift = len(s) - gcplus.LENGTH
        if s[-gcplus.CHECK_NT :] not in gcplus.codebook() or abs(shift) >= gcplus.LIMIT:
            continue
        check, best = gcplus.codebook().index(s[-gcplus.CHECK_NT :]), None
        for pattern in gcplus.patterns(shift, int(abs(shift) <= 1)) if shift else [{i: 0} for i in range(n)] + list(gcplus.patterns(0, 1))[1:]:
            ends = np.cumsum([gcplus.PER + pattern.get(i, 0) for i in range(n)]).tolist()
            cut = [s[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            word = np.array([0 if i in pattern else int(gcplus._symbols(x)[0]) for i, x in enumerate(cut)] + [check])
            fixed = f.correct(word, sorted(pattern))
            if fixed is not None and all(i in pattern or fixed[i] == word[i] for i in range(n + 1)):
                cost = sum(int(gcplus.edit_distances(cut[i], np.frombuffer(gcplus._nt(fixed[i : i + 1]).encode(), np.uint8)[None, :])[0]) for i in pattern)
                # Without a shift one changed symbol goes before pairs of blocks.
                rank = (0 if not shift and len(pattern) == 1 else cost, fixed[: gcplus.SYMBOLS].astype(np.uint8).tobytes())
                best = rank if best is None or rank[0] < best[0] else best
        assert gcplus.decode_block(s) == ((bytes(21), False) if best is None else (best[1], True))
    word = np.random.default_rng(1).integers(0, 4, (30, 16)).astype(np.uint8)
    for free in (False, True):
        assert [gcplus.edit_distances("".join(gcplus.ORDER[b] for b in w), letters, free).tolist() for w in word] == gcplus._distances(word, gcplus._book()[0], free).tolist()


def test_tied_guesses():
    """A strand one edit from two codewords gives both; a payload's seal picks, and says so where it can't."""
    strand = b"TCTTTCTATGTATCCTACAATCATACGCACAATATTTCGCTCCTTCGCTCGGTGACACAATGACTCTTTCTTTCGCTGTATCTTCGGTCTGGGCTGTCCTACT"
    others: dict = {}
    out, ok = gcplus.decode_rows(np.frombuffer(strand, np.uint8), np.array([0, len(strand)]), others)
    assert ok[0] and others == {0: {b"edti a. Eninor reenti"}} and out[0].tobytes() != b"edti a. Eninor reenti"
    data = bytes(range(63)) + b"tail"
    whole = (data + zlib.crc32(data).to_bytes(4)).ljust(84, b"\0")
    hit = lambda i: whole[: 21 * i] + bytes(21) + whole[21 * (i + 1) :]
    right = lambda i, *more: {"strand_idx": i, "others": b"".join(more) + whole[21 * i : 21 * (i + 1)]}
    assert gcplus.chosen(hit(1), [right(1, b"z" * 21), {"strand_idx": 2, "others": b"q" * 21}], 67) == data + zlib.crc32(data).to_bytes(4)
    assert gcplus.chosen(hit(3), [right(3)], 67) == data + zlib.crc32(data).to_bytes(4)
    assert gcplus.chosen(hit(1), [{"strand_idx": 1, "others": b"z" * 21}], 67) is None


def test_paired_segments():
    r = random.Random(3)
    for _ in range(20):
        a, b = ("".join(r.choice("01") for _ in range(64)) for _ in range(2))
        assert wukong.separate(wukong.combine(a, b, 1), 1) == (a, b)


def test_profiles_hit_their_rates():
    seq = "".join(random.Random(0).choice("ACGT") for _ in range(4000))
    for k, p in {**SYNTHESIS, **SEQUENCING}.items():
        out, edits = mesa.mutate(np.random.default_rng(k), seq, p)
        change = sum({"insertion": 1, "deletion": -1}.get(e[0], 0) for e in edits)
        assert len(out) - len(seq) == change
        want = p.raw_rate * (p.mismatch + p.deletion + p.insertion) * len(seq)
        assert len(edits) <= want + 6 * want**0.5 + 1
        assert p.raw_rate or out == seq


@settings(max_examples=30, deadline=None)
@given(st.lists(st.one_of(st.none(), st.binary(max_size=40)), max_size=12))
def test_byte_kernels(data):
    for alphabet, width in (("AGCT", 4), ("01", 8)):
        out = kernels.column_of(*kernels._spread(kernels._letters(alphabet, width))(*kernels.flat(pa.array(data, pa.binary()))), pa.string())
        bits = 8 // width
        want = [None if x is None else "".join(alphabet[(b >> (bits * k)) & (2**bits - 1)] for b in x for k in range(width - 1, -1, -1)) for x in data]
        assert out.to_pylist() == want
        back = kernels._gathered(kernels._codes(alphabet), width)(*kernels.flat(out.slice(1)))
        assert kernels.column_of(*back, pa.binary()).to_pylist() == data[1:]


def test_kernel_rejects():
    got = kernels.column_of(*kernels._gathered(kernels._codes("AGCT"), 4)(*kernels.flat(pa.array(["AGCT", "AGC", "NNNN", "", None, "TTTT"]))), pa.binary())
    assert got.to_pylist() == [b"\x1b", None, None, b"", None, b"\xff"]


def test_indels_of_a_batch():
    """Rates, reconciliation of every edit, and independence of how reads are batched."""
    r = random.Random(2)
    seqs = ["".join(r.choice("ACGT") for _ in range(r.randint(0, 300))) for _ in range(400)]
    data, bounds, _ = kernels.flat(pa.array(seqs))
    keys = channels._mixed(np.arange(400, dtype=np.uint64))
    out, ends, edits = channels.indel_batch(data, bounds, keys, 0.02, 0.03, 0.05)
    texts, n = kernels.column_of(out, ends, None, pa.string()).to_pylist(), {"insertion": 0, "deletion": 0, "mismatch": 0}
    for seq, text, own in zip(seqs, texts, edits.to_pylist(), strict=True):
        rebuilt, at = "", 0
        for e in own:
            n[e["mode"]] += 1
            rebuilt += seq[at : e["pos"]]
            at = e["pos"]
            if e["mode"] != "insertion":
                assert e["orig"] == seq[at] and e["mod"] != seq[at]
                at += 1
            rebuilt += e["mod"]
        assert rebuilt + seq[at:] == text
    total = sum(map(len, seqs))
    assert all(abs(n[k] / total - p) < 0.004 for k, p in (("insertion", 0.02), ("deletion", 0.03), ("mismatch", 0.05 * 0.97)))
    d2, b2, _ = kernels.flat(pa.array(seqs[100:]))
    assert kernels.column_of(*channels.indel_batch(d2, b2, keys[100:], 0.02, 0.03, 0.05)[:2], None, pa.string()).to_pylist() == texts[100:]


def test_trailers():
    for b, width in ((2, 20), (1, 40)):
        for n in (1, 2, 3, 17, 300):
            for _ in range(20):
                rows = random.sample(range(n), min(n, random.randint(1, width * b // word_ecc._index_width(n))))
                assert sorted(word_ecc.chosen_rows(word_ecc.trailer(rows, n, b, width), n, b)) == sorted(rows)


def test_payloads_of_as_many_words_share_symbols(monkeypatch):
    """The rows of fountain symbols are drawn and peeled once for each number of words; all words peel."""
    tried, peel = [], word_ecc.peel
    monkeypatch.setattr(word_ecc, "peel", lambda n, s: tried.append(n) or peel(n, s))
    for n in (1, 23, 23, 400, 400):
        flat, starts, rows = word_ecc._peeling(n, 6 * n, 10, 31)
        assert np.split(flat, starts[1:])[-1].tolist() == rows[-1] and len(rows) == 6 * n
        assert len(peel(n, [(r, np.zeros(1, np.uint8)) for r in rows])) == n
    # Tasks find it by its name, so what it keeps is the worker's.
    assert pickle.loads(pickle.dumps(word_ecc._peeling)) is word_ecc._peeling
    assert len(set(tried)) == 3 and tried == sorted(tried) and word_ecc._peeling(23, 138, 10, 31)[2] is word_ecc._peeling(23, 138, 10, 31)[2]


def test_votes():
    t = pa.table({"k": pa.array([1, 1, 1, None, None, 2]), "seq": ["ACGT", "ACGA", "TCNAG", "NN", "", "GG"], "ord": pa.array([0, 1, 2, 0, 1, 0])})
    starts = reads._group_starts(t, 1)
    assert starts.tolist() == [0, 3, 5]
    assert reads._voted(t, starts, 1, ["k", "seq", "n_reads"]).to_pylist() == [{"k": 1, "seq": "ACGAG", "n_reads": 3}, {"k": None, "seq": "AA", "n_reads": 2}, {"k": 2, "seq": "GG", "n_reads": 1}]


def test_swap_distance():
    for a, b, d in (("", "", 0), ("ab", "ba", 1), ("ca", "abc", 2), ("kitten", "sitting", 3), ("ACGT", "AGCT", 1)):
        assert reads.swap_distance(a, b) == d
