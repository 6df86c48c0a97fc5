"""Files in and out: binary payloads, FASTA, FASTQ, libraries, archives, JSON exports, profiles."""

from __future__ import annotations

import gzip
import io
import tarfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bits

MIB = 1 << 20


def read_payloads(spark: SparkSession, path: str, glob: str | None = None, max_bytes: int | None = None) -> DataFrame:
    """payload_id, name, content, n_bytes of files or a folder's files; ids follow a hash of the path. max_bytes drops larger files."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(path)
    if max_bytes is not None:
        df = df.filter(F.col("length") <= max_bytes)
    return df.select(F.xxhash64("path").alias("payload_id"), F.element_at(F.split("path", "/"), -1).alias("name"), "content", F.col("length").alias("n_bytes"))


def payloads_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A table's texts as payloads; null texts go."""
    content = F.encode(F.col(text_col), "UTF-8")
    return df.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("payload_id"), content.alias("content"), F.octet_length(text_col).cast("long").alias("n_bytes"))


def total_bytes(payload: DataFrame) -> DataFrame:
    return payload.agg(F.sum("n_bytes").alias("total_bytes"))


def restored_name(name):
    """<base>_restored<ext>."""
    return F.regexp_replace(name, r"^(.*?)(\.[^.]*)?$", "$1_restored$2")


def text_bits(text):
    """Eight bits a character by its code, more for codes above 255: the compatible text form. Use bytes_to_bits for whole round trips."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    code = lambda c: F.bin(F.ascii(c).cast("long"))
    return F.array_join(F.transform(chars, lambda c: F.when(F.char_length(code(c)) < 8, F.lpad(code(c), 8, "0")).otherwise(code(c))), "")


def latin_text(bit_string):
    return F.decode(bits.bits_to_bytes(bit_string), "ISO-8859-1")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, description, seq (upper case): a record is what follows a >."""
    lines = spark.read.text(path, lineSep=">")
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    seq = F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s", ""))
    return lines.filter(F.trim("value") != "").select(F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.trim(F.regexp_replace(head, r"^\S*", "")).alias("description"), seq.alias("seq"))


def write_fasta(strand: DataFrame, path: str, name: str = "name", seq: str = "seq") -> None:
    strand.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col(seq)).alias("value")).write.mode("overwrite").text(path)


def write_fastq(reads: DataFrame, path: str, name: str = "name", seq: str = "seq", quality: str = "quality") -> None:
    reads.select(F.concat(F.lit("@"), F.col(name), F.lit("\n"), F.col(seq), F.lit("\n+\n"), F.col(quality)).alias("value")).write.mode("overwrite").text(path)


def codec_header(meta: dict) -> str:
    """First FASTA header of a codec file: its constants."""
    return ",".join(f"{k}={v}" for k, v in meta.items())


def parse_codec_header(header):
    """A codec header column as a map."""
    return F.str_to_map(header, F.lit(","), F.lit("="))


def read_library(spark: SparkSession, path: str) -> DataFrame:
    """idx, oligo: the first column of each line, in order."""
    df = spark.read.option("header", False).option("ignoreTrailingWhiteSpace", True).csv(path)
    w = Window.orderBy("at")
    return df.select(F.trim("_c0").alias("oligo"), F.monotonically_increasing_id().alias("at")).filter("oligo <> ''").select((F.row_number().over(w) - 1).alias("idx"), "oligo")


def read_positional_library(spark: SparkSession, path: str, sections: tuple[str, ...] = ("Messages", "Generic", "Connector")) -> DataFrame:
    """section, idx, seq: lines below each section's marker."""
    lines = spark.read.text(path).select(F.trim("value").alias("v"), F.monotonically_increasing_id().alias("at")).filter("v <> ''")
    marker = F.when(F.regexp_replace("v", r"[^A-Za-z]", "").isin(*sections), F.regexp_replace("v", r"[^A-Za-z]", ""))
    w = Window.orderBy("at")
    marked = lines.withColumn("m", marker).withColumn("section", F.last("m", ignorenulls=True).over(w)).filter(F.col("m").isNull() & F.col("section").isNotNull())
    return marked.select("section", (F.row_number().over(Window.partitionBy("section").orderBy("at")) - 1).alias("idx"), F.col("v").alias("seq"))


def archive(payload: DataFrame, group: str = "archive_id", level: int = 9) -> DataFrame:
    """payload with a group column -> group, content: tar.gz of each group's files in order of name, times fixed at 0."""

    def run(key, table):
        raw = io.BytesIO()
        with gzip.GzipFile(fileobj=raw, mode="wb", compresslevel=level, mtime=0) as z, tarfile.open(fileobj=z, mode="w") as tar:
            for r in sorted(table.select(["name", "content"]).to_pylist(), key=lambda x: x["name"]):
                info = tarfile.TarInfo(r["name"])
                info.size = len(r["content"])
                tar.addfile(info, io.BytesIO(r["content"]))
        return pa.table({group: pa.array([key[0].as_py()], pa.int64()), "content": pa.array([raw.getvalue()], pa.binary())})

    return payload.select(F.col(group).cast("long").alias(group), "name", "content").groupBy(group).applyInArrow(run, f"{group} long, content binary")


def unarchive(archives: DataFrame, group: str = "archive_id") -> DataFrame:
    """group, content -> group, name (its last part only), content."""

    def run(batches):
        for b in batches:
            rows = []
            for g, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with tarfile.open(fileobj=io.BytesIO(c), mode="r:gz") as tar:
                    rows += [(g, m.name.rpartition("/")[2], tar.extractfile(m).read()) for m in tar.getmembers() if m.isfile()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.binary())], names=[group, "name", "content"])

    return archives.select(F.col(group).cast("long").alias(group), "content").mapInArrow(run, f"{group} long, name string, content binary")


def export_json(df: DataFrame, name: str = "json") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def import_json(df: DataFrame, schema: str, name: str = "json") -> DataFrame:
    return df.select(F.from_json(name, schema).alias("x")).select("x.*")


def read_profiles(spark: SparkSession, url: str | None = None, table: str | None = None, **options) -> DataFrame:
    """Error profiles: from a database by JDBC, or those that come with the package."""
    if url:
        return spark.read.jdbc(url, table, properties=options)
    from ..plans.profiles import SEQUENCING, SYNTHESIS

    rows = [(i, kind, p.name, float(p.raw_rate), float(p.mismatch), float(p.deletion), float(p.insertion)) for kind, table_ in (("synthesis", SYNTHESIS), ("sequencing", SEQUENCING)) for i, p in sorted(table_.items())]
    return spark.createDataFrame(rows, "id int, kind string, name string, raw_rate double, mismatch double, deletion double, insertion double")
