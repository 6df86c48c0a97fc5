"""URL filtering by host-suffix / path-prefix rules.

Every URL expands into (host suffix, path prefix) expressions. Expressions and
rules meet in an equi-join on the first bytes of their digests; the full digest
confirms, and the longest rule wins. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import added_names, fresh, maybe_broadcast

#: (host, path prefix, verdict). Fixed values.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
DEFAULT_VERDICT = "allow"
#: Hex digits of the digest that the join compares: 4 bytes.
SHORT = 8
#: Groups that the URLs of a host are judged in.
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\x00"), path), 256)


def judge_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """urls with host, path, rule and verdict added (as host_, path_, ... if such columns exist).

    A rule fits its host and all subdomains if the path starts with the rule's;
    the longest rule (host and path together) wins, then the longer host, then
    block before allow. A null URL or one without :// has empty host and path
    and gets the default verdict. Rules with a null part are ignored, repeated
    ones count once. Repeated URL rows are judged alike; each row stays. An
    empty table gives an empty result. A very long URL has as many expressions
    as rules have host depths and path lengths, whatever its labels.
    """
    rules = (
        rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull())
        .select(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
        .groupBy("r_host", "r_path")
        .agg(F.max("r_verdict").alias("r_verdict"))
        .withColumn("r_digest", _digest(F.col("r_host"), F.col("r_path")))
        .withColumn("short", F.substring("r_digest", 1, SHORT))
    )
    # Host depths and path lengths that rules have: as many as there are different ones.
    labels = lambda c: F.size(F.split(c, r"\."))
    seen = rules.agg(F.array_sort(F.collect_set(F.char_length("r_path"))).alias("n"), F.array_sort(F.collect_set(labels("r_host"))).alias("deep")).first()
    lengths, longest = seen["n"] or [0], max(seen["n"] or [0])
    h, p, cut, salt, kh, kc, ks, won = (fresh(urls, x) for x in ("host", "path", "cut", "salt", "k_host", "k_cut", "k_salt", "won"))
    parsed = urls.withColumns({h: host_of(F.col(url_col)), p: path_of(F.col(url_col))})
    # A host of very many URLs is judged once in each of SALTS groups, so its rows spread over as many tasks.
    parsed = parsed.withColumns({cut: F.substring(p, 1, longest), salt: F.pmod(F.xxhash64(F.col(url_col)), F.lit(SALTS)).cast("int")})
    keys = parsed.select(F.col(h).alias("k_host"), F.col(cut).alias("k_cut"), F.col(salt).alias("k_salt")).distinct()
    suffixes = F.array(*[F.when(labels("k_host") >= n, F.substring_index("k_host", ".", -n)) for n in seen["deep"]]).cast("array<string>")
    suffixes = F.filter(suffixes, lambda x: x.isNotNull())
    prefixes = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.char_length("k_cut")), lambda n: F.substring(F.col("k_cut"), F.lit(1), n))
    expressions = (
        keys.select("k_host", "k_cut", "k_salt", F.explode(suffixes).alias("e_host"), prefixes.alias("e_paths"))
        .select("k_host", "k_cut", "k_salt", "e_host", F.explode("e_paths").alias("e_path"))
        .withColumn("e_digest", _digest(F.col("e_host"), F.col("e_path")))
        .withColumn("short", F.substring("e_digest", 1, SHORT))
    )
    fit = expressions.join(maybe_broadcast(rules), "short").filter(F.col("e_digest") == F.col("r_digest"))
    rank = F.struct(F.char_length(F.concat("r_host", "r_path")).alias("n"), F.char_length("r_host").alias("m"), F.col("r_verdict").alias("v"), F.concat("r_host", "r_path").alias("rule"))
    verdicts = fit.groupBy(F.col("k_host").alias(kh), F.col("k_cut").alias(kc), F.col("k_salt").alias(ks)).agg(F.max(rank).alias(won))
    joined = parsed.join(verdicts, (F.col(h) == F.col(kh)) & (F.col(cut) == F.col(kc)) & (F.col(salt) == F.col(ks)), "left")
    names = dict(zip(("host", "path", "rule", "verdict"), added_names(urls, "host", "path", "rule", "verdict"), strict=True))
    return joined.select(
        *[F.col(f"`{c}`") for c in urls.columns],
        F.col(h).alias(names["host"]),
        F.col(p).alias(names["path"]),
        F.col(f"{won}.rule").alias(names["rule"]),
        F.coalesce(F.col(f"{won}.v"), F.lit(default)).alias(names["verdict"]),
    )
