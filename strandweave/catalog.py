"""Registered queries over the driver's tables, each with its SQL twin where SQL has one."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ecc import fountain, reed_solomon
from .functions import bits, nt, rng
from .operators import assembly, channels, codecs, experiments, gcplus, mesa, qc, random_data, reads, wukong
from .plans import codec_plan
from .plans.profiles import MOTIF_PROB, MOTIFS, SEQUENCING
from .scratch import dealt
from .sources import files

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

PLAN = codec_plan.max_density(100)
FLAT = codec_plan.no_homopolymer(100, barcode=20)
#: Plans with error correction: parities of a fifth of the message; fountain symbols; both.
MAX_RS, MAX_LT, MAX_BOTH = codec_plan.max_density(200, 14, 0.8), codec_plan.max_density(200, 14, 1.0, (20, 10)), codec_plan.max_density(200, 14, 0.8, (20, 10))
FLAT_RS = codec_plan.no_homopolymer(240, 24, 0.8)
CHURCH = {"capacity": 120, "index_bits": 20}
RUN = 4


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name; whole numbers are bigint on both sides."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.select(*[(F.col(f.name).cast("long").alias(f.name) if isinstance(f.dataType, T.IntegerType | T.ShortType | T.ByteType) else F.col(f.name)) for f in df.schema])

        _queries[fn.__name__] = run
        if sql:
            _sql[fn.__name__] = sql
        return fn

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# inputs and their SQL twins ---------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.payloads_of(table(spark, sf_dir, "documents"), "doc_id", "text")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One strand a customer: its name's bytes. The file is small and channels work on every base, so its rows are dealt."""
    t = dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")
    return t.select(F.col("c_custkey").alias("payload_id"), F.lit(0).alias("strand_idx"), F.lit(0).alias("copy_no"), nt.bytes_to_dna(F.encode(F.col("c_name"), "UTF-8")).alias("dna"))


def talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").filter("text <> ''")
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("payload_id"), F.encode(F.col("text"), "UTF-8").alias("content"), F.octet_length("text").cast("long").alias("n_bytes"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part")
    return t.select(F.col("p_partkey").alias("read_id"), nt.bytes_to_dna(F.encode(F.concat_ws(" ", "p_name", "p_type"), "UTF-8")).alias("seq"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("read_id"), nt.bytes_to_dna(F.encode(F.col("text"), "UTF-8")).alias("seq"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("read_id"), nt.bytes_to_dna(F.encode(F.col("text"), "UTF-8")).alias("seq"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as strands, a price's digits long."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(F.col("l_orderkey").alias("payload_id"), F.col("l_linenumber").alias("strand_idx"), "l_returnflag", nt.bytes_to_dna(F.encode(F.concat_ws("|", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), "l_returnflag", "l_linestatus"), "UTF-8")).alias("dna"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One strand an order."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("payload_id"), F.lit(0).alias("strand_idx"), "o_orderpriority", nt.bytes_to_dna(F.encode(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderpriority"), "UTF-8")).alias("dna"))


def _replaced(expr: str, codes: list[str]) -> str:
    for digit, code in zip(bits.HEX, codes, strict=True):
        expr = f"replace({expr}, '{digit}', '{code}')"
    return expr


def dna_of(text: str, order: str = nt.DENSE) -> str:
    return _replaced(f"lower(hex(encode({text})))", [order[i >> 2] + order[i & 3] for i in range(16)])


def bits_of(text: str) -> str:
    return "translate(" + _replaced(f"lower(hex(encode({text})))", [f"{i:04b}".replace("0", "x").replace("1", "y") for i in range(16)]) + ", 'xy', '01')"


def digits_of(n: str, base: int, width: int) -> str:
    return f"right(repeat('0', {width}) || lower(to_base(({n})::BIGINT, {base})), {width})"


CUSTOMERS = f"(SELECT c_custkey AS payload_id, 0 AS strand_idx, 0 AS copy_no, {dna_of('c_name')} AS dna FROM customer)"
PARTS = f"(SELECT p_partkey AS read_id, {dna_of(chr(39).join(['p_name || ', ' ', ' || p_type']))} AS seq FROM part)"
TURNS = f"(SELECT conv_id * 1000 + turn AS read_id, {dna_of('text')} AS seq FROM conversations)"
ITEMS = f"(SELECT item_id AS read_id, {dna_of('text')} AS seq FROM benchmark)"
LINES = "(SELECT l_orderkey AS payload_id, l_linenumber AS strand_idx, l_returnflag, {} AS dna FROM lineitem)".format(dna_of("concat_ws('|', l_partkey::VARCHAR, l_suppkey::VARCHAR, l_returnflag, l_linestatus)"))
DOCS = "(SELECT doc_id AS payload_id, text FROM documents WHERE text IS NOT NULL)"
TALKS = "(SELECT conv_id * 1000 + turn AS payload_id, text FROM conversations WHERE text <> '')"


def gc_of(s: str) -> str:
    return f"(length({s}) - length(translate({s}, 'GC', '')))"


def revcomp_of(s: str) -> str:
    return f"reverse(translate({s}, 'ACGT', 'TGCA'))"


# scalars ----------------------------------------------------------------------------------------


@query(f"SELECT payload_id, length({bits_of('text')}) AS n_bits, md5({bits_of('text')}) AS bits_md5 FROM {DOCS}")
def bits_encode(spark, d):
    b = bits.bytes_to_bits(F.col("content"))
    return documents(spark, d).select("payload_id", F.char_length(b).alias("n_bits"), F.md5(b.cast("binary")).alias("bits_md5"))


@query(f"SELECT payload_id, md5(text) AS bytes_md5, true AS same FROM {DOCS}")
def bits_decode(spark, d):
    back = bits.bits_to_bytes(bits.bytes_to_bits(F.col("content")))
    return documents(spark, d).select("payload_id", F.md5(back).alias("bytes_md5"), (back == F.col("content")).alias("same"))


@query(f"SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, {digits_of('l_orderkey', 3, 8)} AS trits, {digits_of('l_orderkey', 4, 6)} AS quads, {digits_of('l_orderkey', 2, 10)} AS bits FROM lineitem")
def base_counters(spark, d):
    k = F.col("l_orderkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", bits.digits(k, 3, 8).alias("trits"), bits.digits(k, 4, 6).alias("quads"), bits.digits(k, 2, 10).alias("bits"))


@query("SELECT sum(octet_length(encode(text)))::BIGINT AS total_bytes FROM " + DOCS)
def total_bytes(spark, d):
    return files.total_bytes(documents(spark, d))


@query(f"""
WITH s AS (SELECT payload_id, {dna_of('text')} AS dna FROM {DOCS})
SELECT payload_id, length(dna) AS n, length(dna) - length(replace(dna, 'A', '')) AS a, length(dna) - length(replace(dna, 'C', '')) AS c,
       length(dna) - length(replace(dna, 'G', '')) AS g, length(dna) - length(replace(dna, 'T', '')) AS t, md5({revcomp_of('dna')}) AS revcomp_md5 FROM s""")
def nt_composition(spark, d):
    s = documents(spark, d).select("payload_id", nt.bytes_to_dna(F.col("content")).alias("dna"))
    return s.select("payload_id", F.char_length("dna").alias("n"), *[nt.count_base(F.col("dna"), b).alias(b.lower()) for b in "ACGT"], F.md5(nt.reverse_complement(F.col("dna")).cast("binary")).alias("revcomp_md5"))


@query(f"""
WITH s AS (SELECT payload_id, {dna_of('text')} AS dna FROM {DOCS})
SELECT payload_id, CASE WHEN length(dna) > 0 THEN round({gc_of('dna')}::DOUBLE / length(dna), 6) END AS gc,
       coalesce(list_max(list_transform(regexp_extract_all(dna, 'A+|C+|G+|T+'), lambda x: length(x))), 0) AS longest_run FROM s""")
def gc_and_runs(spark, d):
    s = documents(spark, d).select("payload_id", nt.bytes_to_dna(F.col("content")).alias("dna"))
    return s.select("payload_id", F.round(nt.gc_fraction(F.col("dna")), 6).alias("gc"), nt.longest_run(F.col("dna")).alias("longest_run"))


@query(f"""
WITH s AS (SELECT read_id, seq FROM {PARTS})
SELECT read_id, CASE WHEN length(seq) < 25 THEN 4 * {gc_of('seq')} + 2 * (length(seq) - {gc_of('seq')}) END AS melting,
       NOT regexp_matches(right(seq, 8), 'AAAA|CCCC|GGGG|TTTT') AS stable_end, least(seq, {revcomp_of('seq')}) AS canonical FROM s""")
def primer_checks(spark, d):
    s = F.col("seq")
    return parts(spark, d).select("read_id", nt.melting_point(s).alias("melting"), nt.stable_end(s).alias("stable_end"), nt.canonical(s).alias("canonical"))


@query(f"SELECT payload_id, md5(text) AS bytes_md5, octet_length(encode(text)) AS packed_bytes FROM {DOCS}")
def dna_pack_unpack(spark, d):
    s = documents(spark, d).select("payload_id", nt.bytes_to_dna(F.col("content"), nt.PACKED).alias("dna"))
    p = s.select("payload_id", "dna", nt.pack(F.col("dna")).alias("packed"))
    back = nt.dna_to_bytes(nt.unpack(F.col("packed"), F.char_length("dna")), nt.PACKED)
    return p.select("payload_id", F.md5(back).alias("bytes_md5"), F.octet_length("packed").alias("packed_bytes"))


@query(f"""
WITH s AS (SELECT a.read_id, a.seq AS x, b.seq AS y FROM {PARTS} a JOIN {PARTS} b ON b.read_id = a.read_id + 1)
SELECT read_id, (SELECT count(*) FROM range(1, least(length(x), length(y)) + 1) r(i) WHERE substr(x, i, 1) <> substr(y, i, 1)) + abs(length(x) - length(y)) AS hamming, levenshtein(x, y) AS edits FROM s""")
def strand_distances(spark, d):
    s = parts(spark, d)
    both = s.select("read_id", F.col("seq").alias("x")).join(s.select((F.col("read_id") - 1).alias("read_id"), F.col("seq").alias("y")), "read_id")
    return both.select("read_id", bits.hamming(F.col("x"), F.col("y")).alias("hamming"), F.levenshtein("x", "y").alias("edits"))


@query(f"""
WITH s AS (SELECT p_partkey AS read_id, {bits_of('p_name')} AS x, {bits_of('p_type')} AS y FROM part)
SELECT read_id, [i - 1 FOR i IN range(1, least(length(x), length(y)) + 1) IF substr(x, i, 1) <> substr(y, i, 1)]::BIGINT[]::VARCHAR AS places FROM s""")
def hamming_diff_positions(spark, d):
    t = table(spark, d, "part")
    x, y = (bits.bytes_to_bits(F.encode(F.col(c), "UTF-8")) for c in ("p_name", "p_type"))
    s = t.select(F.col("p_partkey").alias("read_id"), x.alias("x"), y.alias("y"))
    return s.select("read_id", F.concat(F.lit("["), F.array_join(bits.diff_positions(F.col("x"), F.col("y")), ", "), F.lit("]")).alias("places"))


# codecs -----------------------------------------------------------------------------------------

_MAX = f"""
WITH s AS (SELECT payload_id, {dna_of('text')} AS d FROM {DOCS}),
cut AS (SELECT payload_id, i AS strand_idx, substr(d, (i * {PLAN.message} + 1)::BIGINT, {PLAN.message}) AS part FROM s, range(0, (length(d) + {PLAN.message - 1}) // {PLAN.message}) r(i)),
strands AS (
  SELECT payload_id, strand_idx,
         translate({digits_of('strand_idx', 4, PLAN.barcode)}, '0123', 'AGCT')
         || translate({digits_of(f'CASE WHEN length(part) < {PLAN.message} THEN 2 * length(part) ELSE 0 END', 4, PLAN.header)}, '0123', 'AGCT') || lpad(part, {PLAN.message}, 'A') AS dna FROM cut)
"""


@query(_MAX + "SELECT * FROM strands")
def dna_encode_max_density(spark, d):
    return codecs.encode_max_density(documents(spark, d), PLAN)


@query(f"SELECT payload_id, md5(text) AS bytes_md5, (4 * octet_length(encode(text)) + {PLAN.message - 1}) // {PLAN.message} AS n_strands, 0::BIGINT AS n_missing FROM {DOCS} WHERE text <> ''")
def dna_decode_max_density(spark, d):
    back = codecs.decode_max_density(codecs.encode_max_density(documents(spark, d), PLAN), PLAN)
    return back.select("payload_id", F.md5("content").alias("bytes_md5"), "n_strands", "n_missing")


@query(f"""
WITH s AS (SELECT payload_id, {bits_of('text')} AS b FROM {DOCS}),
cut AS (SELECT payload_id, i AS strand_idx, substr(b, (i * {FLAT.payload_bits} + 1)::BIGINT, {FLAT.payload_bits}) AS part FROM s, range(0, (length(b) + {FLAT.payload_bits - 1}) // {FLAT.payload_bits}) r(i)),
w AS (SELECT payload_id, strand_idx, {digits_of('strand_idx', 2, FLAT.barcode)} || {digits_of(f'CASE WHEN length(part) < {FLAT.payload_bits} THEN length(part) ELSE 0 END', 2, FLAT.header)} || lpad(part, {FLAT.payload_bits}, '0') AS w FROM cut)
SELECT payload_id, strand_idx, array_to_string(list_transform(range(1, length(w) + 1), lambda i: substr('TGCA', 1 + (substr(w, i, 1) = '1')::INT + 2 * ((i - 1) % 2)::INT, 1)), '') AS dna FROM w""")
def dna_encode_no_homopolymer(spark, d):
    return codecs.encode_no_homopolymer(documents(spark, d), FLAT)


@query(f"SELECT payload_id, md5(text) AS bytes_md5 FROM {DOCS} WHERE text <> ''")
def dna_decode_no_homopolymer(spark, d):
    """All contents: the barcode has room for a million strands."""
    return codecs.decode_no_homopolymer(codecs.encode_no_homopolymer(documents(spark, d), FLAT), FLAT).select("payload_id", F.md5("content").alias("bytes_md5"))


def _hit_bases(strand: DataFrame, plan: codec_plan.StrandPlan, every: int) -> DataFrame:
    """In one strand of 32, every `every`-th base after the barcode replaced by another, from a place that a hash gives."""
    n = F.char_length("dna")
    first = F.pmod(F.xxhash64("payload_id", "strand_idx"), F.lit(every)).cast("int") + plan.barcode + 1
    places = F.sequence(first, n, F.lit(every))
    other = lambda s, i: F.translate(F.substring(s, i, F.lit(1)), "ACGT", "CGTA")
    hit = F.aggregate(places, F.col("dna"), lambda s, i: F.overlay(s, other(s, i), i, F.lit(1)))
    return strand.withColumn("dna", F.when(F.pmod(F.xxhash64(F.lit("hit"), "payload_id", "strand_idx"), F.lit(32)) == 0, hit).otherwise(F.col("dna")))


_WHOLE = f"SELECT payload_id, md5(text) AS bytes_md5, 0::BIGINT AS n_missing, 0::BIGINT AS n_failed FROM {DOCS} WHERE text <> ''"


def _restored(back: DataFrame) -> DataFrame:
    return back.select("payload_id", F.md5("content").alias("bytes_md5"), "n_missing", "n_failed")


@query(_WHOLE)
def roundtrip_max_density_rs(spark, d):
    """One strand of 32 has a base of each 60 changed; its parities restore it."""
    return _restored(codecs.decode_max_density(_hit_bases(codecs.encode_max_density(documents(spark, d), MAX_RS), MAX_RS, 60), MAX_RS))


@query(_WHOLE)
def roundtrip_no_homopolymer_rs(spark, d):
    """One strand of 32 has a base of each 120 changed."""
    hit = _hit_bases(codecs.encode_no_homopolymer(documents(spark, d), FLAT_RS), FLAT_RS, 120)
    return _restored(codecs.decode_no_homopolymer(hit, FLAT_RS))


@query(_WHOLE)
def roundtrip_max_density_lt(spark, d):
    """Fountain symbols of every document; its words peel from them. Symbols are many for each document, so these are dealt."""
    return _restored(codecs.decode_max_density(codecs.encode_max_density(dealt(documents(spark, d), "payload_id"), MAX_LT, 5.0), MAX_LT))


@query(_WHOLE)
def roundtrip_max_density_rs_lt(spark, d):
    """Parities inside the words of fountain symbols."""
    return _restored(codecs.decode_max_density(codecs.encode_max_density(dealt(documents(spark, d), "payload_id"), MAX_BOTH, 5.0), MAX_BOTH))


_K = CHURCH["capacity"] - CHURCH["index_bits"]
_SEG = f"""
WITH s AS (SELECT payload_id, {bits_of('text')} AS b FROM {DOCS}),
cut AS (SELECT payload_id, i, rpad(substr(b, (i * {_K} + 1)::BIGINT, {_K}), {_K}, '0') AS part FROM s, range(0, (length(b) + {_K - 1}) // {_K}) r(i))
"""


@query(_SEG + f", w AS (SELECT payload_id, i AS strand_idx, {digits_of('i', 2, CHURCH['index_bits'])} || part AS b FROM cut) SELECT payload_id, strand_idx, translate(regexp_replace(regexp_replace(b, '{'0' * (RUN + 1)}', '{'A' * RUN}C', 'g'), '{'1' * (RUN + 1)}', '{'G' * RUN}T', 'g'), '01', 'AG') AS dna FROM w")
def dna_encode_church(spark, d):
    return codecs.encode_church(documents(spark, d), run=RUN, **CHURCH)


def _sizes(payload: DataFrame) -> DataFrame:
    return payload.filter(F.octet_length("content") > 0).select("payload_id", (F.octet_length("content") * 8).alias("n_bits"))


@query(f"SELECT payload_id, md5(text) AS bytes_md5, 0::BIGINT AS n_lost, 0::BIGINT AS n_repaired FROM {DOCS} WHERE text <> ''")
def dna_decode_church(spark, d):
    p = documents(spark, d)
    back = codecs.decode_church(codecs.encode_church(p, run=RUN, **CHURCH), _sizes(p), CHURCH["index_bits"], capacity=CHURCH["capacity"])
    return back.select("payload_id", F.md5("content").alias("bytes_md5"), "n_lost", "n_repaired")


@query(_SEG + f"""
SELECT payload_id, (i // 2 * 3 + i % 2)::BIGINT AS seg_idx, part FROM cut
UNION ALL
SELECT payload_id, (i // 2 * 3 + 2)::BIGINT, CASE WHEN count(*) = 1 THEN min(part) ELSE array_to_string(list_transform(range(1, {_K} + 1), lambda j: CASE WHEN substr(min(part), j, 1) = substr(max(part), j, 1) THEN '0' ELSE '1' END), '') END
FROM cut GROUP BY payload_id, i // 2""")
def segment_redundancy_xor(spark, d):
    s = codecs.segments(documents(spark, d), CHURCH["capacity"], CHURCH["index_bits"], True)
    return s.select("payload_id", "seg_idx", F.substring("bits", CHURCH["index_bits"] + 1, _K).alias("part"))


@query(f"SELECT payload_id, md5(text) AS bytes_md5, 0::BIGINT AS n_lost FROM {DOCS} WHERE text <> ''")
def segment_repair(spark, d):
    """One segment of each triple lost, by hash; all are rebuilt."""
    p = documents(spark, d)
    s = codecs.segments(p, CHURCH["capacity"], CHURCH["index_bits"], True)
    gone = F.pmod(F.xxhash64("payload_id", F.floor(F.col("seg_idx") / 3)), F.lit(3)) == F.col("seg_idx") % 3
    # At most one of a triple goes, so none is lost.
    kept = s.filter(~gone)
    back = codecs.repair_segments(kept, _sizes(p), CHURCH["index_bits"], True, CHURCH["capacity"])
    return back.select("payload_id", F.md5(bits.bits_to_bytes(F.col("bits"))).alias("bytes_md5"), "n_lost")


_TRITS = "array_to_string(list_transform(range(0, length(h) // 2), lambda i: CASE WHEN ('0x' || substr(h, 2 * i + 1, 2))::INT <= 235 THEN right('00000' || to_base(('0x' || substr(h, 2 * i + 1, 2))::INT, 3), 5) ELSE to_base(('0x' || substr(h, 2 * i + 1, 2))::INT + 472, 3) END), '')"


@query(f"""
WITH h AS (SELECT conv_id * 1000 + turn AS payload_id, hex(encode(text)) AS h FROM conversations WHERE text <> ''),
t AS (SELECT payload_id, {_TRITS} AS t FROM h),
w AS (SELECT payload_id, i AS strand_idx, {digits_of('i', 3, 10)} || rpad(substr(t, (i * 25 + 1)::BIGINT, 100), 100, '0') AS w FROM t, range(0, greatest((length(t) + 24) // 25 - 3, 1)) r(i)),
p AS (SELECT payload_id, strand_idx, j, sum(substr(w, j, 1)::INT + 1) OVER (PARTITION BY payload_id, strand_idx ORDER BY j) % 4 AS s FROM w, range(1, 111) q(j))
SELECT payload_id, strand_idx, string_agg(substr('ACGT', (s + 1)::BIGINT, 1), '' ORDER BY j) AS dna FROM p GROUP BY payload_id, strand_idx""")
def dna_encode_goldman(spark, d):
    return codecs.encode_goldman(talks(spark, d))


@query("SELECT conv_id * 1000 + turn AS payload_id, md5(text) AS bytes_md5, 0::BIGINT AS n_quarters_lost FROM conversations WHERE text <> ''")
def dna_decode_goldman(spark, d):
    """A quarter of the strands, chosen by hash, is lost; overlaps make up for what they can. Here the strands that each quarter needs stay."""
    p = talks(spark, d)
    sizes = p.select("payload_id", F.char_length(codecs.byte_trits(F.col("content"))).alias("n_trits"))
    # A strand's payload tells its size, so no window has to look for the last strand.
    sized = p.select(F.struct("payload_id", F.char_length(codecs.byte_trits(F.col("content"))).alias("n_trits")).alias("payload_id"), "content")
    last = F.greatest(F.ceil(F.col("payload_id.n_trits") / 25).cast("int") - 3, F.lit(1)) - 1
    s = codecs.encode_goldman(sized).withColumn("last", last).withColumn("payload_id", F.col("payload_id.payload_id"))
    kept = s.filter((F.col("strand_idx") % 4 != 2) | (F.col("strand_idx") < 3) | (F.col("strand_idx") > F.col("last") - 3))
    return codecs.decode_goldman(kept.drop("last"), sizes).select("payload_id", F.md5("content").alias("bytes_md5"), "n_quarters_lost")


@query(f"SELECT payload_id, md5(text) AS bytes_md5, true AS ok FROM {DOCS}")
def roundtrip_rs(spark, d):
    """Bytes with 20 parities a word, one byte in every 40 flipped (at most ten errors a word), restored."""
    coded = reed_solomon.protect_column(documents(spark, d), 20)
    # 40 bytes at a time: the first half of the first byte.
    hit = F.array_join(F.transform(bits.pieces(F.hex("coded"), 80), lambda x: F.overlay(x, F.when(F.left(x, F.lit(1)) == "F", "0").otherwise("F"), F.lit(1), F.lit(1))), "")
    back = reed_solomon.restore_column(coded.withColumn("coded", F.unhex(hit)), 20)
    return back.select("payload_id", F.md5("decoded.content").alias("bytes_md5"), F.col("decoded.ok").alias("ok"))


@query(f"SELECT payload_id, md5(text) AS bytes_md5 FROM {DOCS} WHERE text <> ''")
def roundtrip_lt(spark, d):
    """Rows of 64 bytes as fountain symbols, some lost; what peeling finds is compared."""
    p = documents(spark, d).filter("n_bytes > 0")
    h = F.hex("content")
    rows = p.select("payload_id", "n_bytes", F.posexplode(bits.pieces(h, 128)).alias("row", "h")).select("payload_id", "n_bytes", "row", F.unhex(F.rpad("h", 128, "0")).alias("data"))
    symbols = fountain.encode_payloads(rows.drop("n_bytes"), overhead=3.0, seed=9)
    back = fountain.decode_payloads(symbols.filter(F.pmod(F.col("symbol"), F.lit(10)) != 3), seed=9)
    joined = back.groupBy("payload_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", F.hex("data").alias("h")))), lambda x: x["h"]), "").alias("h"))
    return joined.join(p.select("payload_id", "n_bytes"), "payload_id").select("payload_id", F.md5(F.unhex(F.left("h", (F.col("n_bytes") * 2).cast("int")))).alias("bytes_md5"))


@query("SELECT conv_id * 1000 + turn AS payload_id, md5(text) AS bytes_md5, 0::BIGINT AS n_lost FROM conversations WHERE text <> ''")
def roundtrip_wukong(spark, d):
    p = talks(spark, d)
    back = wukong.decode(wukong.encode(p), _sizes(p))
    return back.select("payload_id", F.md5("content").alias("bytes_md5"), "n_lost")


def _gc_blocks(spark, d, *keep, seal=False):
    """The file is small and guessing is work, so turns are dealt."""
    t = dealt(talks(spark, d), "payload_id")
    return gcplus.encode(gcplus.sealed(t) if seal else t, *keep)


def _gc_damaged(spark, d, *keep, seal=False):
    """Strands that have lost, gained or changed one base of their payload part, by hash."""
    h = F.xxhash64("payload_id", "strand_idx")
    at = (F.pmod(h, F.lit(90)) + 1).cast("int")
    kind = F.pmod(F.shiftright(h, 20), F.lit(3))
    other = F.translate(F.substring(F.col("dna"), at, F.lit(1)), "ACGT", "CGTA")
    return _gc_blocks(spark, d, *keep, seal=seal).withColumn("dna", F.overlay("dna", F.when(kind == 0, "").otherwise(other), at, F.when(kind == 1, 0).otherwise(1)))


@query("""SELECT conv_id * 1000 + turn AS payload_id, md5(text) AS bytes_md5, true AS ok FROM conversations WHERE text <> ''""")
def roundtrip_gcplus(spark, d):
    """Every strand has lost, gained or changed one base of its payload part; all decode. A few strands of a million are one edit from two codewords: the turn's seal tells."""
    back = gcplus.opened(gcplus.decode(_gc_damaged(spark, d, "n_bytes", seal=True), "n_bytes", ties=True), "n_bytes")
    return back.select("payload_id", F.md5("content").alias("bytes_md5"), "ok")


@query("SELECT s_suppkey AS payload_id, 6::BIGINT AS n_rows, true AS ok FROM supplier")
def outer_rs(spark, d):
    """Six rows a supplier with four parity rows; four rows are lost and rebuilt."""
    t = table(spark, d, "supplier").select(F.col("s_suppkey").alias("payload_id"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("row"))
    rows = t.withColumn("symbols", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.pmod(F.xxhash64("payload_id", "row", i), F.lit(1 << 14)).cast("int")))
    coded = reed_solomon.outer_encode(rows, 4, 14)
    kept = coded.filter(F.pmod(F.col("row") + F.col("payload_id"), F.lit(10)) >= 4)
    back = reed_solomon.outer_decode(kept, 6, 4, 14).withColumnRenamed("symbols", "got")
    return back.join(rows, ["payload_id", "row"]).groupBy("payload_id").agg(F.count("*").alias("n_rows"), F.min(F.col("ok") & (F.col("got") == F.col("symbols"))).alias("ok"))


@query("SELECT conv_id AS archive_id, turn::VARCHAR || '.txt' AS name, md5(text) AS bytes_md5 FROM conversations WHERE text IS NOT NULL")
def archive_roundtrip(spark, d):
    t = table(spark, d, "conversations").filter("text is not null").select(F.col("conv_id").alias("archive_id"), F.concat(F.col("turn").cast("string"), F.lit(".txt")).alias("name"), F.encode(F.col("text"), "UTF-8").alias("content"))
    return files.unarchive(files.archive(t)).select("archive_id", "name", F.md5("content").alias("bytes_md5"))


# channels ---------------------------------------------------------------------------------------


def _copies_sql(source: str, mean: float, std: float, seed: int) -> str:
    return f"(SELECT *, unnest(range(0, greatest(1, trunc({mean} + {std} * {rng.normal_sql(str(seed), chr(39) + 'copies' + chr(39), 'payload_id', 'strand_idx')})::BIGINT))) AS copy_no FROM {source})"


def _store_sql(source: str, condition: str, years: float, seed: int) -> str:
    u = rng.uniform_sql(str(seed), f"'store'", f"'{condition}'", "payload_id", "strand_idx", "copy_no")
    return f"(SELECT * FROM {source} WHERE {u} > 1 - pow({1 - channels.DECAY[condition]!r}, length(dna) * {float(years)}))"


@query(f"SELECT l_returnflag, count(*) AS n_reads, sum(copy_no)::BIGINT AS copies_sum FROM {_copies_sql(LINES, 4.0, 2.0, 1)} GROUP BY l_returnflag")
def synthesis_copies(spark, d):
    c = channels.copies(lines(spark, d), 4, 2, 1)
    return c.groupBy("l_returnflag").agg(F.count("*").alias("n_reads"), F.sum("copy_no").alias("copies_sum"))


_YEARS = {"biogene": 100000, "newstorage": 1000000, "permafrost": 2000, "roomtemperature": 10}


def _storage(condition: str) -> None:
    def run(spark, d):
        kept = channels.store(lines(spark, d).withColumn("copy_no", F.lit(0)), condition, _YEARS[condition], 5)
        return kept.groupBy("l_returnflag").agg(F.count("*").alias("n_left"), F.sum("payload_id").alias("key_sum"))

    run.__name__ = f"storage_{condition}"
    query(f"SELECT l_returnflag, count(*) AS n_left, sum(payload_id)::BIGINT AS key_sum FROM {_store_sql(f'(SELECT *, 0 AS copy_no FROM {LINES})', condition, _YEARS[condition], 5)} GROUP BY l_returnflag")(run)


for _condition in channels.DECAY:
    _storage(_condition)

_CHAIN = [("permafrost", 1000.0), ("roomtemperature", 3.0)]


@query(f"SELECT l_returnflag, count(*) AS n_left FROM {_store_sql(_store_sql(_copies_sql(LINES, 3.0, 1.0, 2), 'permafrost', 1000.0, 8), 'roomtemperature', 3.0, 9)} GROUP BY l_returnflag")
def storage_chain(spark, d):
    c = channels.store_chain(channels.copies(lines(spark, d), 3, 1, 2), _CHAIN, 8)
    return c.groupBy("l_returnflag").agg(F.count("*").alias("n_left"))


def _iid_sql(rate: float, seed: int, distinct: bool) -> str:
    hit, base = (rng.uniform_sql(str(seed), f"'{w}'", "payload_id", "strand_idx", "copy_no", "i") for w in ("hit", "base"))
    new = f"substr(replace('ACGT', b, ''), (floor({base} * 3) + 1)::BIGINT, 1)" if distinct else f"substr('ACGT', (floor({base} * 4) + 1)::BIGINT, 1)"
    return f"""
WITH s AS (SELECT payload_id, strand_idx, copy_no, dna, i, substr(dna, i, 1) AS b FROM {CUSTOMERS}, range(1, length(dna) + 1) r(i)),
x AS (SELECT payload_id, i, b, CASE WHEN {hit} < {rate} THEN {new} ELSE b END AS n FROM s)
SELECT payload_id, string_agg(n, '' ORDER BY i) AS read, count(*) FILTER (WHERE n <> b) AS n_changed FROM x GROUP BY payload_id"""


@query(_iid_sql(0.05, 3, False))
def channel_iid(spark, d):
    return channels.substitute_iid(customers(spark, d), 0.05, 3).select("payload_id", "read", "n_changed")


@query(_iid_sql(0.05, 4, True))
def channel_iid_distinct(spark, d):
    return channels.substitute_iid(customers(spark, d), 0.05, 4, distinct=True).select("payload_id", "read", "n_changed")


_OWN = channels.ILLUMINA_STAY / (channels.ILLUMINA_STAY + 0.003)


@query(f"""
WITH s AS (SELECT payload_id, strand_idx, copy_no, length(dna) AS n, i, substr(dna, i, 1) AS b FROM {CUSTOMERS}, range(1, length(dna) + 1) r(i)),
u AS (SELECT *, {rng.uniform_sql('6', "'base'", 'payload_id', 'strand_idx', 'copy_no', 'i')} AS u, {rng.uniform_sql('6', "'hit'", 'payload_id', 'strand_idx', 'copy_no', 'i')} AS h FROM s),
x AS (SELECT payload_id, i, CASE WHEN h < 0.5 * (i - 1) / n AND u >= {_OWN!r} THEN substr(replace('ACGT', b, ''), least(floor((u - {_OWN!r}) / (1 - {_OWN!r}) * 3) + 1, 3)::BIGINT, 1) ELSE b END AS b FROM u)
SELECT payload_id, string_agg(b, '' ORDER BY i) AS read FROM x GROUP BY payload_id""")
def channel_illumina_subs(spark, d):
    return channels.substitute_by_position(customers(spark, d), channels.ILLUMINA_STAY, 6, slope=0.5).select("payload_id", "read")


def _poisson_levels(c: float) -> list[float]:
    import math

    top, total, term, out = max(8, math.ceil(c + 10 * math.sqrt(c))), 0.0, math.exp(-c), []
    for i in range(top + 1):
        total += term
        out.append(total)
        term *= c / (i + 1)
    return out


_DRAWN = rng.uniform_sql("7", "'coverage'", "payload_id", "strand_idx")


@query(f"""
WITH s AS (SELECT *, unnest(range(0, len(list_filter({_poisson_levels(2.5)!r}, lambda x: x <= {_DRAWN})))) AS copy_no FROM {LINES}),
f AS (SELECT *, {rng.uniform_sql('7', "'flip'", 'payload_id', 'strand_idx', 'copy_no')} < 0.3 AS reversed FROM s)
SELECT l_returnflag, count(*) AS n_reads, count(*) FILTER (WHERE reversed) AS n_reversed, count(DISTINCT CASE WHEN reversed THEN {revcomp_of('dna')} ELSE dna END) AS n_distinct FROM f GROUP BY l_returnflag""")
def sampling_coverage(spark, d):
    r = channels.sample_coverage(lines(spark, d), 2.5, 0.3, 7)
    return r.groupBy("l_returnflag").agg(F.count("*").alias("n_reads"), F.count_if("reversed").alias("n_reversed"), F.count_distinct("read").alias("n_distinct"))


def _reconciled(df: DataFrame) -> DataFrame:
    """Per read: edits of each kind, and whether applying them to the original gives the read."""
    kind = lambda m: F.size(F.filter("mutated.edits", lambda e: e["mode"] == m))
    return qc.apply_edits(df).select("payload_id", "strand_idx", "copy_no", kind("insertion").alias("n_ins"), kind("deletion").alias("n_del"), kind("mismatch").alias("n_sub"), (F.col("rebuilt") == F.col("mutated.seq")).alias("reconciled"), F.col("mutated.seq").alias("read"))


@query()
def channel_nanopore(spark, d):
    return _reconciled(channels.channel_indel(customers(spark, d), 0.01, 0.01, 0.01, 11, slope=True))


@query()
def channel_mesa(spark, d):
    return _reconciled(mesa.mutate_reads(customers(spark, d), SEQUENCING[38], 12))


@query()
def channel_mesa_synthesis(spark, d):
    return _reconciled(mesa.synthesis(customers(spark, d).drop("copy_no"), 5, 3, 1, 13))


@query()
def channel_markov(spark, d):
    return _reconciled(channels.channel_markov(customers(spark, d), 0.02, 0.02, 0.03, seed=14))


@query()
def channel_burst(spark, d):
    return _reconciled(channels.burst(customers(spark, d), 10, 0.5, 15))


@query()
def channel_estimate(spark, d):
    return channels.estimate_channel(channels.channel_markov(customers(spark, d), 0.02, 0.02, 0.03, seed=14))


@query()
def homopolymer_slips(spark, d):
    return channels.homopolymer_slips(customers(spark, d), 0.3, 16).select("payload_id", "read")


@query()
def alignment_rates(spark, d):
    m = channels.channel_indel(customers(spark, d), 0.02, 0.02, 0.02, 17).withColumn("read", F.col("mutated.seq"))
    return channels.alignment_rates(m).groupBy().agg(*[F.sum(c).alias(c) for c in ("n_match", "n_sub", "n_ins", "n_del")])


@query()
def random_storage(spark, d):
    r = channels.random_storage(customers(spark, d), 18, per=20).withColumnRenamed("dna", "read")
    return r.join(customers(spark, d).select("payload_id", "dna"), "payload_id").select("payload_id", "read", bits.hamming(F.col("dna"), F.col("read")).alias("n_changed"))


# quality control --------------------------------------------------------------------------------

_GC_ERROR = "least(1.0, CASE WHEN gc < 0.5 THEN (0.5 - gc) * 2.5 WHEN gc > 0.6 THEN (gc - 0.6) * 2.0 ELSE 0.0 END)"


@query(f"""
WITH s AS (SELECT read_id, seq, i AS startpos, substr(seq, (i + 1)::BIGINT, 50) AS w FROM {TURNS}, range(0, length(seq), 50) r(i)),
g AS (SELECT read_id, startpos, startpos + length(w) - 1 AS endpos, {gc_of('w')}::DOUBLE / length(w) AS gc FROM s)
SELECT read_id, startpos, endpos, round(gc, 6) AS gc, round({_GC_ERROR}, 6) AS errorprob FROM g""")
def gc_windowed(spark, d):
    return qc.gc_windows(turns(spark, d), 50).select("read_id", "startpos", "endpos", F.round("gc", 6).alias("gc"), F.round("errorprob", 6).alias("errorprob"))


@query(f"WITH g AS (SELECT read_id, length(seq) - 1 AS endpos, {gc_of('seq')}::DOUBLE / length(seq) AS gc FROM {TURNS} WHERE seq <> '') SELECT read_id, 0::BIGINT AS startpos, endpos, round(gc, 6) AS gc, round({_GC_ERROR}, 6) AS errorprob FROM g")
def gc_overall(spark, d):
    return qc.overall_gc(turns(spark, d).filter("seq <> ''")).select("read_id", "startpos", "endpos", F.round("gc", 6).alias("gc"), F.round("errorprob", 6).alias("errorprob"))


_RUNS = """
WITH r AS (SELECT read_id, unnest(regexp_extract_all(seq, 'A+|C+|G+|T+')) AS r, generate_subscripts(regexp_extract_all(seq, 'A+|C+|G+|T+'), 1) AS i FROM {0}),
p AS (SELECT read_id, left(r, 1) AS base, length(r) AS n, (sum(length(r)) OVER (PARTITION BY read_id ORDER BY i))::BIGINT AS e FROM r),
h AS (SELECT read_id, base, e - n AS startpos, e - 1 AS endpos, CASE n WHEN 3 THEN 0.3 WHEN 4 THEN 0.6 WHEN 5 THEN 0.9 ELSE 1.0 END::DOUBLE AS errorprob FROM p WHERE n >= 3)
"""


@query(_RUNS.format(TURNS) + "SELECT * FROM h")
def homopolymer_runs(spark, d):
    return qc.homopolymers(turns(spark, d))


@query(f"SELECT k AS kmer, count(*) AS n FROM (SELECT unnest(list_transform(range(1, length(seq) - 4), lambda i: substr(seq, i, 6))) AS k FROM {TURNS}) GROUP BY k")
def kmer_count(spark, d):
    return qc.kmer_counts(turns(spark, d), 6)


_KMERS = f"""
WITH k AS (SELECT read_id, i - 1 AS startpos, substr(seq, i, 8) AS kmer FROM {PARTS}, range(1, length(seq) - 6) r(i)),
n AS (SELECT *, count(*) OVER (PARTITION BY read_id, kmer) AS n FROM k)
SELECT read_id, kmer, n, startpos, startpos + 7 AS endpos, round(least(1.0::DOUBLE, n * n * 0.000002::DOUBLE), 9) AS errorprob FROM n WHERE n > 1"""


@query(_KMERS)
def kmer_repeats(spark, d):
    return qc.repeated_kmers(parts(spark, d), 8).withColumn("errorprob", F.round("errorprob", 9))


def _motifs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, MOTIF_PROB) for m in MOTIFS], "motif string, errorprob double")


@query(f"SELECT read_id, m AS motif, i - 1 AS startpos, i + length(m) - 2 AS endpos, 1.0::DOUBLE AS errorprob FROM {ITEMS}, range(1, length(seq) + 1) r(i), unnest({list(MOTIFS)!r}) t(m) WHERE substr(seq, i, length(m)) = m")
def motif_scan(spark, d):
    return qc.motif_hits(items(spark, d), _motifs(spark))


_STACK = _RUNS.format(PARTS) + f""",
g AS (SELECT read_id, i AS startpos, i + length(substr(seq, (i + 1)::BIGINT, 15)) - 1 AS endpos, {gc_of('substr(seq, (i + 1)::BIGINT, 15)')}::DOUBLE / length(substr(seq, (i + 1)::BIGINT, 15)) AS gc FROM {PARTS}, range(0, length(seq), 15) r(i)),
iv AS (SELECT read_id, startpos, endpos, errorprob FROM h UNION ALL SELECT read_id, startpos, endpos, {_GC_ERROR} FROM g),
st AS (SELECT read_id, pos, least(1.0, sum(errorprob)) AS prob FROM (SELECT read_id, errorprob, unnest(range(startpos, endpos + 1)) AS pos FROM iv) GROUP BY read_id, pos)
"""


def _intervals(spark, d):
    p = parts(spark, d)
    return qc.homopolymers(p).select("read_id", "startpos", "endpos", "errorprob").unionByName(qc.gc_windows(p, 15).select("read_id", "startpos", "endpos", "errorprob"))


@query(_STACK + "SELECT read_id, pos, round(prob, 6) AS prob FROM st")
def error_prob_stack(spark, d):
    return qc.stacked(_intervals(spark, d)).withColumn("prob", F.round("prob", 6))


@query(_STACK + """, q AS (SELECT read_id, pos, round(prob, 4) AS prob FROM st), x AS (SELECT *, pos - row_number() OVER (PARTITION BY read_id, prob ORDER BY pos) AS g FROM q)
SELECT read_id, min(pos) AS startpos, max(pos) AS endpos, prob FROM x GROUP BY read_id, prob, g""")
def error_segments(spark, d):
    return qc.segments_of(qc.stacked(_intervals(spark, d)).withColumn("prob", F.round("prob", 4)))


@query(_RUNS.format(PARTS) + """, k AS (""" + _KMERS.replace("WITH k AS", "WITH kk AS").replace("FROM k)", "FROM kk)") + """),
iv AS (SELECT read_id, startpos, endpos FROM h UNION ALL SELECT read_id, startpos, endpos FROM k),
m AS (SELECT *, CASE WHEN startpos <= max(endpos) OVER (PARTITION BY read_id ORDER BY startpos, endpos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM iv),
g AS (SELECT *, sum(new) OVER (PARTITION BY read_id ORDER BY startpos, endpos ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT read_id, min(startpos) AS startpos, max(endpos) AS endpos, count(*) AS n FROM g GROUP BY read_id, g""")
def error_islands(spark, d):
    p = parts(spark, d)
    return qc.islands(qc.homopolymers(p).select("read_id", "startpos", "endpos").unionByName(qc.repeated_kmers(p, 8).select("read_id", "startpos", "endpos")))


@query(_STACK + f""", q AS (SELECT read_id, pos, chr((33 + least(greatest(round(CASE WHEN prob <= 0 THEN 40.0 WHEN prob >= 1 THEN 0.0 ELSE -10 * log10(round(prob, 9)) END), 0), 40))::INT) AS c FROM st)
SELECT read_id, string_agg(c, '' ORDER BY pos) AS quality FROM q GROUP BY read_id""")
def fastq_quality(spark, d):
    p = parts(spark, d)
    return qc.fastq_quality(p, qc.stacked(_intervals(spark, d)).withColumn("prob", F.round("prob", 9))).select("read_id", "quality")


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(CASE WHEN l_quantity <= 1 THEN 0.0 WHEN l_quantity <= 10 THEN (l_quantity - 1) / 9 * 0.2 WHEN l_quantity <= 25 THEN 0.2 + (l_quantity - 10) / 15 * 0.5
WHEN l_quantity <= 50 THEN 0.7 + (l_quantity - 25) / 25 * 0.3 ELSE 1.0 END, 6) AS prob FROM lineitem""")
def prob_curve(spark, d):
    points = [(1.0, 0.0), (10.0, 0.2), (25.0, 0.7), (50.0, 1.0)]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(qc.curve(points, F.col("l_quantity")), 6).alias("prob"))


@query()
def prob_curve_smooth(spark, d):
    points = [(1.0, 0.0), (10.0, 0.2), (25.0, 0.7), (50.0, 1.0)]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", qc.curve(points, F.col("l_quantity"), smooth=True).alias("prob"))


# reads ------------------------------------------------------------------------------------------


def _noisy(spark, d) -> DataFrame:
    r = channels.substitute_iid(channels.copies(customers(spark, d).drop("copy_no"), 5, 2, 21), 0.03, 22)
    return r.select("payload_id", F.col("read").alias("seq"), F.col("copy_no").alias("ord"))


_NOISY = f"""
WITH c AS (SELECT payload_id, 0 AS strand_idx, dna, unnest(range(0, greatest(1, trunc(5.0 + 2.0 * {rng.normal_sql('21', "'copies'", 'payload_id', '0')})::BIGINT))) AS copy_no FROM {CUSTOMERS}),
b AS (SELECT payload_id, copy_no, i, CASE WHEN {rng.uniform_sql('22', "'hit'", 'payload_id', '0', 'copy_no', 'i')} < 0.03 THEN substr('ACGT', (floor({rng.uniform_sql('22', "'base'", 'payload_id', '0', 'copy_no', 'i')} * 4) + 1)::BIGINT, 1) ELSE substr(dna, i, 1) END AS base FROM c, range(1, length(dna) + 1) r(i)),
noisy AS (SELECT payload_id, copy_no AS ord, string_agg(base, '' ORDER BY i) AS seq FROM b GROUP BY payload_id, copy_no)
"""


@query(_NOISY + """, v AS (SELECT payload_id, i, base, count(*) AS n, min(copy_no) AS o FROM b GROUP BY payload_id, i, base),
w AS (SELECT *, row_number() OVER (PARTITION BY payload_id, i ORDER BY n DESC, o) AS k FROM v),
c2 AS (SELECT payload_id, string_agg(base, '' ORDER BY i) AS seq FROM w WHERE k = 1 GROUP BY payload_id)
SELECT payload_id, seq, n_reads FROM c2 JOIN (SELECT payload_id, count(*) AS n_reads FROM noisy GROUP BY payload_id) USING (payload_id)""")
def read_consensus(spark, d):
    return reads.consensus(_noisy(spark, d), ["payload_id"])


@query(_NOISY + """, s AS (SELECT payload_id, count(*) AS n FROM noisy GROUP BY payload_id), m AS (SELECT median(n) AS mid FROM s),
dd AS (SELECT median(abs(n - mid)) AS mad, max(mid) AS mid FROM s, m)
SELECT payload_id, n AS n_group FROM s, dd WHERE abs(n - mid) <= 1.5 * mad""")
def read_group_mad(spark, d):
    return reads.mad_filter(_noisy(spark, d), ["payload_id"], 1.5).select("payload_id", F.col("n_group")).distinct()


@query(_NOISY + """, g AS (SELECT payload_id, seq, count(*) AS n, min(ord) AS ord FROM noisy GROUP BY payload_id, seq)
SELECT payload_id, seq, n, ord FROM (SELECT *, max(n) OVER (PARTITION BY payload_id) AS most FROM g) WHERE n >= 2 OR most < 2""")
def read_multicopy_filter(spark, d):
    return reads.multicopy(_noisy(spark, d), ["payload_id"])


@query(_NOISY + """, e AS (SELECT payload_id, 'left' AS side, left(seq, 12) AS e FROM noisy UNION ALL SELECT payload_id, 'right', right(seq, 12) FROM noisy),
n AS (SELECT payload_id, side, e, row_number() OVER (PARTITION BY payload_id, side ORDER BY count(*) DESC, e) AS k FROM e GROUP BY payload_id, side, e)
SELECT payload_id, max(e) FILTER (WHERE side = 'left') AS left, max(e) FILTER (WHERE side = 'right') AS right FROM n WHERE k = 1 GROUP BY payload_id""")
def primer_mode(spark, d):
    return reads.modal_ends(_noisy(spark, d), ["payload_id"], 12)


@query(_NOISY + """, n AS (SELECT payload_id, length(seq) AS len, count(*) AS n FROM noisy GROUP BY 1, 2), m AS (SELECT payload_id, len, row_number() OVER (PARTITION BY payload_id ORDER BY n DESC, len) AS k FROM n)
SELECT payload_id, count(*) AS n_reads FROM noisy JOIN m USING (payload_id) WHERE k = 1 AND length(seq) = len GROUP BY payload_id""")
def modal_length(spark, d):
    return reads.modal_length(_noisy(spark, d), ["payload_id"]).groupBy("payload_id").agg(F.count("*").alias("n_reads"))


@query(_NOISY + """, g AS (SELECT payload_id, seq, count(*) AS n FROM noisy GROUP BY 1, 2), t AS (SELECT payload_id, sum(n) AS total FROM g GROUP BY 1)
SELECT payload_id, count(*) FILTER (WHERE n >= greatest(2.0, total / 30)) AS originals FROM g JOIN t USING (payload_id) GROUP BY payload_id""")
def originals_estimate(spark, d):
    return reads.estimated_originals(reads.distinct_reads(_noisy(spark, d), ["payload_id"]), ["payload_id"])


@query(_NOISY + """, g AS (SELECT payload_id, seq, count(*) AS n, min(ord) AS ord FROM noisy GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY payload_id ORDER BY n DESC, ord) AS rank FROM g),
pairs AS (SELECT q.payload_id, q.ord AS qid, c.rank, (SELECT count(*) FROM range(1, length(q.seq) + 1) t(i) WHERE substr(q.seq, i, 1) <> substr(c.seq, i, 1)) AS d FROM noisy q JOIN r c ON c.payload_id = q.payload_id AND c.rank <= 2)
SELECT payload_id, qid, rank, d AS distance FROM (SELECT *, row_number() OVER (PARTITION BY payload_id, qid ORDER BY d, rank) AS k FROM pairs) WHERE k = 1""")
def cluster_nearest(spark, d):
    """Reads to the nearer of their group's two most frequent ones. Names have 18 bytes, strands 72 bases."""
    noisy = _noisy(spark, d)
    centres = reads.greedy_centres(reads.distinct_reads(noisy, ["payload_id"]), ["payload_id"], 2)
    return reads.nearest_by_hamming(noisy.withColumnRenamed("ord", "qid"), centres, 72, ["payload_id"])


@query(f"""
WITH l AS (SELECT n_nationkey AS idx, {dna_of('n_name')} AS oligo FROM nation), q AS (SELECT s_suppkey AS qid, {dna_of('s_name')} AS seq FROM supplier)
SELECT qid, idx::BIGINT AS idx, d AS distance FROM (SELECT qid, idx, levenshtein(seq, oligo) AS d, row_number() OVER (PARTITION BY qid ORDER BY levenshtein(seq, oligo), idx) AS k FROM q, l) WHERE k = 1""")
def levenshtein_nearest(spark, d):
    dna = lambda c: nt.bytes_to_dna(F.encode(F.col(c), "UTF-8"))
    q = table(spark, d, "supplier").select(F.col("s_suppkey").alias("qid"), dna("s_name").alias("seq"))
    return reads.nearest_by_edits(q, table(spark, d, "nation").select(F.col("n_nationkey").alias("idx"), dna("n_name").alias("oligo")))


@query("""
WITH v AS (SELECT l_linenumber AS pos, l_shipdate::DATE::VARCHAR AS value, l_orderkey AS ord FROM lineitem), c AS (SELECT pos, value, count(*) AS n, min(ord) AS o FROM v GROUP BY 1, 2)
SELECT pos::BIGINT AS pos, value, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY n DESC, o, value) AS rank FROM c) WHERE rank <= 3""")
def top_per_position(spark, d):
    v = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("pos"), F.col("l_shipdate").cast("date").cast("string").alias("value"), F.col("l_orderkey").alias("ord"))
    return reads.top_per_position(v, 3)


@query(_MAX + f"SELECT least(dna, {revcomp_of('dna')}) AS canonical, count(*) AS n FROM strands GROUP BY 1")
def revcomp_canonical_distinct(spark, d):
    s = codecs.encode_max_density(documents(spark, d), PLAN)
    return s.groupBy(nt.canonical(F.col("dna")).alias("canonical")).agg(F.count("*").alias("n"))


@query(_MAX + f", w AS (SELECT dna FROM strands) SELECT count(*) AS n, count(*) FILTER (WHERE coalesce(list_max(list_transform(regexp_extract_all(dna, 'A+|C+|G+|T+'), lambda x: length(x))), 0) <= 6 AND {gc_of('dna')}::DOUBLE / length(dna) BETWEEN 0.3 AND 0.7) AS n_ok FROM w")
def constraint_windows(spark, d):
    s = codecs.encode_max_density(documents(spark, d), PLAN)
    return s.agg(F.count("*").alias("n"), F.count_if(nt.windows_ok(F.col("dna"), 6, 0.3, 0.7)).alias("n_ok"))


# library ----------------------------------------------------------------------------------------

_LIB = f"(SELECT p_partkey AS idx, {dna_of('right(p_name, 5)')} AS oligo FROM part)"
_MOTIF_SQL = f"""
WITH lib AS (SELECT * FROM {_LIB}), h AS (SELECT left(oligo, 10) AS h FROM lib UNION SELECT substr(oligo, 11, 10) FROM lib), m AS (SELECT DISTINCT least(h, {revcomp_of('h')}) AS motif FROM h),
o AS (SELECT motif, 'a' || row_number() OVER (ORDER BY motif) AS symbol FROM m),
motifs AS (SELECT * FROM o UNION ALL SELECT {revcomp_of('motif')}, symbol || '*' FROM o WHERE {revcomp_of('motif')} NOT IN (SELECT motif FROM o))
"""


def _library(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("idx"), nt.bytes_to_dna(F.encode(F.right(F.col("p_name"), F.lit(5)), "UTF-8")).alias("oligo"))


@query(_MOTIF_SQL + "SELECT * FROM motifs")
def library_motifs(spark, d):
    return assembly.linear_motifs(_library(spark, d))


@query(_MOTIF_SQL + "SELECT idx, oligo, a.symbol AS left_symbol, b.symbol AS right_symbol FROM lib LEFT JOIN motifs a ON a.motif = left(oligo, 10) LEFT JOIN motifs b ON b.motif = substr(oligo, 11, 10)")
def library_translate(spark, d):
    lib = _library(spark, d)
    return assembly.translate_oligos(lib, assembly.linear_motifs(lib))


@query("""
WITH o AS (SELECT p_size, p_brand || ',' || p_type || ',/,x,y' AS a, 'y,x,/,' || p_type || ',' || p_brand AS b FROM part)
SELECT least(a, b) AS key, sum(p_size)::BIGINT AS n FROM o GROUP BY 1""")
def pool_histogram(spark, d):
    """Odd parts come as the mirror images of what even ones are: each key has copies of both."""
    odd = F.col("p_partkey") % 2 == 1
    x, y = F.lit("x"), F.lit("y")
    t = table(spark, d, "part").select(F.when(odd, F.array(y, x)).otherwise(F.array("p_brand", "p_type")).alias("fwd"), F.when(odd, F.array("p_type", "p_brand")).otherwise(F.array(x, y)).alias("rev"), F.col("p_size").alias("n"))
    return assembly.histogram(t)


@query()
def pool_hybridise(spark, d):
    """Pools of one brand each, a copy of each oligo for every part: chains of two-motif oligos that meet by their free ends."""
    t = table(spark, d, "part").groupBy(F.right(F.regexp_replace("p_brand", "[^0-9]", ""), F.lit(2)).cast("long").alias("pool_id")).agg(F.count("*").alias("n"))
    oligo = F.explode(F.array(*[F.struct(F.array(F.lit(a), F.lit(b)).alias("fwd"), F.array(F.lit(c), F.lit(e)).alias("rev")) for a, b, c, e in (("a", "b", "a*", ""), ("", "c", "b*", "c*"), ("c", "d", "", "d*"))]))
    return assembly.hybridise(t.select("pool_id", "n", oligo.alias("o")).select("pool_id", "o.fwd", "o.rev", "n"), seed=3)


# experiments ------------------------------------------------------------------------------------


def _results(spark, d):
    """Customers' strands through a storage sweep: SUCCESS if at least half of three copies survive."""
    c = customers(spark, d).select("payload_id", "strand_idx", "dna", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("copy_no"))
    points = [{"condition": k, "years": y} for k in ("permafrost", "roomtemperature") for y in (1.0, 10.0, 100.0)]

    def one(p: dict) -> DataFrame:
        left = channels.store(c, p["condition"], p["years"], 31).groupBy("payload_id").agg(F.count("*").alias("n"))
        return customers(spark, d).select("payload_id").join(left, "payload_id", "left").select("payload_id", F.when(F.col("n") >= 2, "SUCCESS").otherwise("ERROR").alias("status"))

    return experiments.run_sweep(points, one)


def _results_sql() -> str:
    c = f"(SELECT payload_id, strand_idx, dna, unnest(range(0, 3)) AS copy_no FROM {CUSTOMERS})"
    parts_ = [
        f"SELECT c_custkey AS payload_id, CASE WHEN n >= 2 THEN 'SUCCESS' ELSE 'ERROR' END AS status, '{k}' AS p_condition, {y}::DOUBLE AS p_years FROM customer LEFT JOIN (SELECT payload_id, count(*) AS n FROM {_store_sql(c, k, y, 31)} GROUP BY 1) ON payload_id = c_custkey"
        for k in ("permafrost", "roomtemperature") for y in (1.0, 10.0, 100.0)
    ]
    return "WITH r AS (" + " UNION ALL ".join(parts_) + ")"


@query(_results_sql() + "SELECT p_condition, p_years, count(*) AS n, count(*) FILTER (WHERE status = 'SUCCESS') AS n_success, round(avg((status = 'SUCCESS')::INT), 6) AS success_rate FROM r GROUP BY 1, 2")
def success_rate_by_param(spark, d):
    return experiments.success_rate(_results(spark, d), "p_condition", "p_years").withColumn("success_rate", F.round("success_rate", 6))


@query(_results_sql() + "SELECT p_condition, p_years, count(*) AS n, round(avg((status = 'SUCCESS')::INT), 6) AS success_rate, grouping(p_condition, p_years) AS level FROM r GROUP BY CUBE (p_condition, p_years)")
def success_rate_cube(spark, d):
    return experiments.success_cube(_results(spark, d), "p_condition", "p_years").withColumn("success_rate", F.round("success_rate", 6))


@query(f"""
SELECT p_partkey AS payload_id, CASE WHEN p_name = p_type THEN 'SUCCESS' WHEN octet_length(encode(p_type)) < octet_length(encode(p_name)) THEN 'ERROR_short' WHEN octet_length(encode(p_type)) > octet_length(encode(p_name)) THEN 'ERROR_long' ELSE 'ERROR' END AS status,
       CASE WHEN p_name = p_type THEN 0 ELSE (SELECT count(*) FROM range(1, least(length(p_name), length(p_type)) + 1) r(i) WHERE substr(p_name, i, 1) <> substr(p_type, i, 1)) END AS n_diff FROM part""")
def compare_status(spark, d):
    t = table(spark, d, "part")
    side = lambda c: t.select(F.col("p_partkey").alias("payload_id"), F.encode(F.col(c), "UTF-8").alias("content"))
    return experiments.compare(side("p_name"), side("p_type"))


@query()
def fer_gcplus(spark, d):
    """Frame error rates of the guess-and-check code at three indel rates, on all blocks of the conversations."""
    blocks = _gc_blocks(spark, d, "block").withColumnRenamed("block", "want").withColumn("copy_no", F.lit(0))

    def one(p: dict) -> DataFrame:
        hit = channels.channel_indel(blocks, p["rate"] / 3, p["rate"] / 3, p["rate"] / 3, 41).withColumn("dna", F.col("mutated.seq")).drop("mutated")
        right = F.col("block") == F.col("want")
        return gcplus.decode(hit, "want").select((F.col("ok") & right).alias("ok"), (F.col("ok") & ~right).alias("undetected"))

    return experiments.fer(experiments.run_sweep([{"rate": r} for r in (0.001, 0.01, 0.03)], one), "p_rate")


_STORED_YEARS = 100.0
#: Mean and deviation of a strand's copies.
_COPIES = (10, 1)
#: Insertions, deletions and substitutions a base.
_NOISE = (0.0005, 0.0005, 0.004)
#: Groups of fewer reads are strays: reads whose barcode has an error.
_LEAST_READS = 3


def _called(spark, d) -> DataFrame:
    """Documents to strands, ten copies, storage, a channel with insertions, deletions and substitutions, reads of the right length grouped by their barcodes, strays dropped, consensus."""
    docs = documents(spark, d)
    # Their file is few splits, and documents are of very unequal lengths: they are dealt, then their strands, not yet copied.
    strand = dealt(codecs.encode_max_density(dealt(docs, "payload_id"), PLAN), "payload_id", "strand_idx")
    stored = channels.store(channels.copies(strand, *_COPIES, 51), "permafrost", _STORED_YEARS, 52)
    noisy = channels.indel_seqs(stored, *_NOISE, 53).select("payload_id", "seq", F.xxhash64("strand_idx", "copy_no").alias("ord"))
    whole = noisy.filter(F.char_length("seq") == PLAN.length).withColumn("barcode", reads.barcode(F.col("seq"), PLAN.barcode))
    # A group has no more reads than its payload.
    strands = docs.groupBy("payload_id").agg(F.sum(F.ceil(F.col("n_bytes") * 8 / PLAN.payload_bits)).alias("n")).agg(F.max("n")).first()[0] or 0
    called = reads.consensus(whole, ["payload_id", "barcode"], most=strands * channels.most_copies(*_COPIES))
    return called.filter(F.col("n_reads") >= _LEAST_READS)


@query(None)
def roundtrip_noisy(spark, d):
    """The flagship: through the noisy channel and back; success by language."""
    back = codecs.decode_max_density(_called(spark, d).select("payload_id", F.col("seq").alias("dna")), PLAN).select("payload_id", "content")
    results = experiments.compare(documents(spark, d).filter("n_bytes > 0"), back)
    langs = table(spark, d, "documents").select(F.col("doc_id").alias("payload_id"), "lang")
    return experiments.success_rate(results.join(langs, "payload_id"), "lang")


_EDITS = {
    "nanopore": lambda c: channels.channel_indel(c, 0.01, 0.01, 0.01, 11, slope=True), "mesa": lambda c: mesa.mutate_reads(c, SEQUENCING[38], 12),
    "markov": lambda c: channels.channel_markov(c, 0.02, 0.02, 0.03, seed=14), "burst": lambda c: channels.burst(c, 10, 0.5, 15),
}


@query("SELECT channel, count(*) AS n_reads, count(*) AS n_reconciled FROM customer, unnest(['nanopore', 'mesa', 'markov', 'burst']) t(channel) GROUP BY channel")
def channels_reconcile(spark, d):
    """Of every channel that changes lengths: reads whose edits rebuild them from the original."""
    found = [_reconciled(fn(customers(spark, d))).select(F.lit(k).alias("channel"), "reconciled") for k, fn in _EDITS.items()]
    return reduce(DataFrame.unionByName, found).groupBy("channel").agg(F.count("*").alias("n_reads"), F.count_if("reconciled").alias("n_reconciled"))


def _lengths_sql() -> str:
    return f"SELECT count(*) AS n, sum(length(seq))::BIGINT AS total, round(avg(length(seq)), 6) AS mean, min(length(seq)) AS least, max(length(seq)) AS most FROM {PARTS}"


@query(_lengths_sql())
def length_stats(spark, d):
    s = reads.length_stats(parts(spark, d))
    return s.withColumn("mean", F.round("mean", 6))


@query("SELECT s_suppkey AS qid, idx::BIGINT AS idx, d AS distance FROM (SELECT s_suppkey, n_nationkey AS idx, damerau_levenshtein(substr(s_name, 10), n_name) AS d, row_number() OVER (PARTITION BY s_suppkey ORDER BY damerau_levenshtein(substr(s_name, 10), n_name), n_nationkey) AS k FROM supplier, nation) WHERE k = 1")
def damerau_nearest(spark, d):
    """Nearest nation name by edits and swaps of neighbours; ties go to the least key."""
    q = table(spark, d, "supplier").select(F.col("s_suppkey").alias("qid"), F.expr("substr(s_name, 10)").alias("seq"))
    return reads.nearest_by_swaps(q, table(spark, d, "nation").select(F.col("n_nationkey").alias("idx"), F.col("n_name").alias("oligo")))


@query(f"SELECT l_returnflag, count(*) - (SELECT count(*) FROM {_store_sql(f'(SELECT *, 0 AS copy_no FROM {LINES})', 'permafrost', 2000, 5)} k WHERE k.l_returnflag = l.l_returnflag) AS n_broken, count(*) AS n_strands FROM {LINES} l GROUP BY l_returnflag")
def strand_breaks(spark, d):
    """How many strands a storage breaks, by group."""
    return channels.strand_breaks(lines(spark, d).withColumn("copy_no", F.lit(0)), "permafrost", 2000, 5, "l_returnflag")


@query(f"SELECT l_returnflag, round(count(*) / count(DISTINCT payload_id || '|' || strand_idx), 6) AS mean_copies FROM {_copies_sql(LINES, 4.0, 2.0, 1)} GROUP BY l_returnflag")
def average_copies(spark, d):
    c = channels.copies(lines(spark, d), 4, 2, 1)
    return c.groupBy("l_returnflag").agg(F.round(F.count("*") / F.count_distinct("payload_id", "strand_idx"), 6).alias("mean_copies"))


@query(f"""
WITH l AS (SELECT o_orderkey AS payload_id, 0 AS strand_idx, o_orderpriority, o_orderkey % 7 AS w, {dna_of("o_orderkey || '|' || o_orderpriority")} AS dna FROM orders),
s AS (SELECT *, sum(w) OVER (ORDER BY payload_id, strand_idx) - w AS lo FROM l), t AS (SELECT sum(w)::BIGINT AS total, count(*) AS m FROM l),
d AS (SELECT draw, least(floor(({rng.uniform_sql("'9'", "'draw'", 'draw')} + {rng.uniform_sql("'9'", "'more'", 'draw')} / 4294967296.0) * total), total - 1)::BIGINT AS x,
             {rng.uniform_sql("'9'", "'flip'", 'draw')} < 0.3 AS reversed FROM t, range(0, floor(2.5 * m)::BIGINT) r(draw))
SELECT o_orderpriority, count(*) AS n_reads, count(*) FILTER (WHERE reversed) AS n_reversed, count(DISTINCT CASE WHEN reversed THEN {revcomp_of('dna')} ELSE dna END) AS n_distinct
FROM d JOIN s ON x >= lo AND x < lo + w GROUP BY o_orderpriority""")
def sampling_weighted(spark, d):
    """Orders with weights from 0 to 6, two and a half reads a strand, drawn one by one."""
    r = channels.sample_weighted(orders(spark, d), 2.5, F.col("payload_id") % 7, 0.3, 9)
    return r.groupBy("o_orderpriority").agg(F.count("*").alias("n_reads"), F.count_if("reversed").alias("n_reversed"), F.count_distinct("read").alias("n_distinct"))


@query(f"SELECT c_custkey AS payload_id, 8 * octet_length(encode(c_name)) AS n, true AS in_class, true AS near FROM customer")
def repair_classes(spark, d):
    """Strands of two alternating classes that lost a base anywhere: all other bases return to their places."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("payload_id"), F.lit(0).alias("ord"), nt.alternating(bits.bytes_to_bits(F.encode("c_name", "UTF-8"))).alias("dna"))
    at = (F.floor(rng.uniform(61, "lost", F.col("payload_id")) * F.char_length("dna"))).cast("int")
    hit = c.withColumn("seq", F.concat(F.substring(F.col("dna"), F.lit(1), at), F.substring(F.col("dna"), at + 2, F.char_length("dna"))))
    fixed = reads.repair_classes(hit, 8 * 18, 62)
    whole = F.col("seq").rlike("^([TG][CA])*$")
    return fixed.select("payload_id", F.char_length("seq").alias("n"), whole.alias("in_class"), (bits.hamming(F.col("dna"), F.col("seq")) <= 1).alias("near"))


@query(_NOISY + "SELECT payload_id, seq, count(*) AS n, min(ord) AS ord, count(*) >= 2 AS voted FROM noisy GROUP BY payload_id, seq")
def read_voted_and_single(spark, d):
    return reads.voted_and_single(_noisy(spark, d), ["payload_id"])


@query(_NOISY + "SELECT count(*) AS n_in, count(DISTINCT payload_id) AS n_groups, count(DISTINCT payload_id) AS n_out, count(*) - count(DISTINCT payload_id) AS n_removed FROM noisy")
def process_metrics(spark, d):
    r = _noisy(spark, d)
    return reads.process_metrics(r, reads.consensus(r, ["payload_id"]), ["payload_id"])


@query("""
WITH i AS (SELECT p_partkey, right('0' || p_size, 2) AS a, CASE WHEN p_size % 5 = 0 THEN 'x' ELSE replace(p_brand, 'Brand#', '') END AS b FROM part)
SELECT p_partkey, a || ',' || b AS key, count(*) OVER (PARTITION BY a, b) AS n_group FROM i WHERE b <> 'x'""")
def group_by_first(spark, d):
    """Parts whose first two items are numbers, grouped by them."""
    b = F.when(F.col("p_size") % 5 == 0, "x").otherwise(F.replace("p_brand", F.lit("Brand#"), F.lit("")))
    t = table(spark, d, "part").select("p_partkey", F.array(F.right(F.concat(F.lit("0"), F.col("p_size").cast("string")), F.lit(2)), b, F.col("p_type")).alias("items"))
    return reads.group_by_first(t, 2).select("p_partkey", F.array_join("key", ",").alias("key"), "n_group")


@query("""
SELECT l_orderkey, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) || '|' || string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) || '|' || string_agg(l_suppkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS columns,
       string_agg(l_linenumber || ',' || l_partkey || ',' || l_suppkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS flat FROM lineitem GROUP BY l_orderkey""")
def matrix_transpose(spark, d):
    """An order's lines as a matrix: its columns, and its items row by row."""
    row = F.struct(*[F.col(c).cast("long").alias(c) for c in ("l_linenumber", "l_partkey", "l_suppkey")])
    m = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("r"))
    rows = F.transform("r", lambda x: F.array(x["l_linenumber"], x["l_partkey"], x["l_suppkey"]))
    joined = F.array_join(F.transform(bits.transpose(rows), lambda c: F.array_join(c.cast("array<string>"), ",")), "|")
    return m.select("l_orderkey", joined.alias("columns"), F.array_join(bits.flatten_layers(rows, 1).cast("array<string>"), ",").alias("flat"))


@query(f"SELECT i0 AS strand_idx, dna FROM (SELECT i0, {random_data.random_string_sql('ACGT', '60', 71, 'i0')} AS dna FROM range(0, 500) r(i0))")
def random_strands(spark, d):
    return random_data.strands(spark, 500, 60, 71)


@query(f"SELECT i0 AS payload_id, {random_data.random_string_sql('01', '100', 72, 'i0')} AS bits FROM range(0, 200) r(i0)")
def random_bits(spark, d):
    return random_data.bit_strings(spark, 200, 100, 72)


@query(f"""
WITH l AS (SELECT n_nationkey AS idx, {dna_of('n_name')} AS oligo FROM nation), m AS (SELECT count(*) AS m FROM l)
SELECT c AS codeword_id, string_agg(oligo, ' ' ORDER BY pos) AS oligos FROM (SELECT c, pos, floor({rng.uniform_sql("'73'", "'oligo'", 'c', 'pos')} * m) AS idx FROM m, range(0, 300) r(c), range(0, 8) q(pos)) JOIN l USING (idx) GROUP BY c""")
def random_codewords(spark, d):
    library = table(spark, d, "nation").select(F.col("n_nationkey").alias("idx"), nt.bytes_to_dna(F.encode("n_name", "UTF-8")).alias("oligo"))
    return random_data.codewords(spark, 300, 8, library, 73).select("codeword_id", F.array_join("oligos", " ").alias("oligos"))


_SIZES = [40 * 2**i for i in range(9)]


@query(f"""
WITH f AS (SELECT i - 1 AS file_id, s AS n_bytes FROM (SELECT unnest({_SIZES}) AS s, unnest(range(1, {len(_SIZES) + 1})) AS i)),
p AS (SELECT file_id, n_bytes, piece, least({random_data.PIECE}, n_bytes - piece * {random_data.PIECE}) AS n FROM f, range(0, 100) r(piece) WHERE piece * {random_data.PIECE} < n_bytes)
SELECT file_id, n_bytes::BIGINT AS n_bytes, piece, {random_data.random_string_sql(random_data.LETTERS, 'n', 74, 'file_id', 'piece')} AS text FROM p""")
def random_texts(spark, d):
    return random_data.texts(spark, _SIZES, 74)


@query(f"SELECT unnest({[str(s) for s in _SIZES]}) AS size, 'SUCCESS' AS status, 1::BIGINT AS n_rows, true AS timed")
def duration_by_size(spark, d):
    """Encoding and decoding of random files from 40 bytes on, each twice the size of the one before; times are real, so only whether they were taken is compared."""

    def one(p: dict) -> DataFrame:
        text = codecs.ordered_concat(random_data.texts(spark, [p["size"]], 75), ["file_id"], "piece", "text", "content")
        payload = text.select(F.col("file_id").alias("payload_id"), F.encode("content", "UTF-8").alias("content")).withColumn("n_bytes", F.octet_length("content").cast("long"))
        back = codecs.decode_max_density(codecs.encode_max_density(payload, PLAN), PLAN).select("payload_id", "content")
        return experiments.compare(payload, back).filter("status = 'SUCCESS'")

    runs = experiments.timed_sweep(spark, [{"size": s} for s in _SIZES], one)
    return runs.select(F.col("params")["size"].alias("size"), "status", "n_rows", (F.col("seconds") > 0).alias("timed"))


_DUPLEX = {"A": "AACC", "b": "CCGT", "a": "GTTA", "c": "TTGC"}


@query("SELECT p_partkey, 'AACCCCGT' AS five_prime, 'GTTATTGC' AS three_prime FROM part WHERE p_partkey % 4 < 3")
def back_translate_pool(spark, d):
    """The same duplex from either side and end, and one without the marker, which isn't read."""
    faces = [(["A", "b"], ["a", "c"]), (["b", "A"], ["c", "a"]), (["a", "c"], ["A", "b"]), (["b", "a"], ["c", ""])]
    pick = lambda j: F.get(F.array(*[F.array(*map(F.lit, f[j])) for f in faces]), (F.col("p_partkey") % 4).cast("int"))
    t = table(spark, d, "part").select("p_partkey", pick(0).alias("fwd"), pick(1).alias("rev"))
    return assembly.back_translate_pool(t, _DUPLEX, "A")


def _positional_sql() -> str:
    bars = " UNION ALL ".join(f"SELECT {i}::BIGINT AS position, (SELECT h FROM lh WHERE k = {i // 2 + 1}) AS l, (SELECT h FROM rh WHERE k = {(i + 1) // 2 + 1}) AS r" for i in range(6))
    half = lambda e: f"SELECT h, row_number() OVER (ORDER BY h) AS k FROM (SELECT DISTINCT {e} AS h FROM {_LIB})"
    bad = " OR ".join(f"contains(oligo, {x})" for m in "lr" for x in (m, revcomp_of(m)))
    return f"WITH lh AS ({half('left(oligo, 10)')}), rh AS ({half('substr(oligo, 11, 10)')}), b AS ({bars}) SELECT position, idx, oligo FROM b, {_LIB} WHERE NOT ({bad})"


@query(_positional_sql())
def positional_libraries(spark, d):
    return assembly.positional_libraries(_library(spark, d), 6)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roundtrip_noisy(spark, sf_dir)
