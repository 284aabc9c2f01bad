"""URL filter: host suffixes times path prefixes, equi-joined with rules on a short hash, then confirmed.

Every url becomes its (host suffix, path prefix) expressions; only the prefix lengths that some rule
has are made. Expression and rule meet on the first 8 hex digits of the SHA-256 of ``suffix + path``;
a match counts once the full digests agree, and the longest rule wins. Everything is DataFrame
functions. Rules are never broadcast by a hint: Spark does so where it knows that their table is small, and
else sorts and merges both sides, with hot expressions split by adaptive execution.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.shared import written

#: (verdict, host, path): fixed rules of the contract
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: hex digits of a digest that the join compares; the rest is confirmed afterwards
SHORT = 8
#: what no rule decides
DEFAULT = "allow"


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", default: str = DEFAULT) -> DataFrame:
    """One row per row of ``pages``: key, host, path, rule (null if none fits) and verdict.

    Null or schemeless urls have empty host and path and fit no rule. Repeated rows give repeated
    results; a null key is a key. Two rules of the same text: block wins. No rules: the default.
    """
    # The distinct lengths of rule paths are at most as many as an url is long.
    lengths = sorted(r[0] for r in rules.select(F.length("path")).where("path is not null and host is not null").distinct().collect())
    told = rules.where("path is not null and host is not null").select(
        F.concat("host", "path").alias("_rule"), F.col("verdict").alias("_verdict"), F.sha2(F.concat("host", "path"), 256).alias("_full")
    )
    told = told.groupBy("_rule", "_full").agg(F.max("_verdict").alias("_verdict"))
    # Rules whose digests begin alike are one row, so that an expression meets one row at most. The table is written, so
    # that Spark knows its size: a small one is broadcast, and urls are not shuffled to meet it.
    told = told.groupBy(F.substring("_full", 1, SHORT).alias("_short")).agg(F.collect_list(F.struct(F.length("_rule").alias("n"), F.col("_verdict"), F.col("_rule"), F.col("_full"))).alias("_told"))
    told = written(told, "rules")
    one = pages.select(F.col(key).alias("_key"), F.col("url").alias("_url")).withColumns({"_host": host_of(F.col("_url")), "_path": path_of(F.col("_url"))})
    parts = F.split("_host", r"\.", -1)
    suffixes = F.when(F.col("_host") == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    )
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("_path"))
    prefixes = F.transform(fitting, lambda n: F.substring(F.col("_path"), F.lit(1), n))
    every = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    spread = one.select("_key", "_url", F.posexplode_outer(every).alias("_n", "_said")).withColumn("_digest", F.sha2("_said", 256)).withColumn("_start", F.substring("_digest", 1, SHORT))
    met = spread.join(told, F.col("_start") == F.col("_short"), "left")
    sure = F.filter("_told", lambda r: (r["_full"] == F.col("_digest")) & (r["_rule"] == F.col("_said")))
    # One shuffle, of what tasks have of an url by then: its best rule, and how often its first expression came.
    best = met.groupBy("_key", "_url").agg(F.max(F.get(sure, F.lit(0))).alias("_best"), F.count_if((F.col("_n") == 0) | F.col("_n").isNull()).alias("_times"))
    best = best.withColumn("_each", F.explode(F.array_repeat(F.lit(1), F.col("_times").cast("int"))))
    return best.select(
        F.col("_key").alias(key), host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"), F.col("_best._rule").alias("rule"), F.coalesce("_best._verdict", F.lit(default)).alias("verdict")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules_frame(spark))


ORACLE = """
with rules(verdict, rhost, rpath) as (values ('allow','org','/'), ('block','example.org','/es/'), ('block','example.org','/en/1'), ('allow','com','/fr/'), ('block','com','/de/')),
cut as (select page_id, case when contains(url, '://') then substr(url, position('://' in url) + 3) else '' end as rest from pages),
p as (select row_number() over () as rn, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
fit as (select p.rn, rhost || rpath as rule, verdict, row_number() over (partition by p.rn order by length(rhost || rpath) desc, verdict desc) as k
  from p join rules on (p.host = rhost or ends_with(p.host, '.' || rhost)) and starts_with(p.path, rpath))
select p.page_id, p.host, p.path, fit.rule, coalesce(fit.verdict, 'allow') as verdict from p left join fit on p.rn = fit.rn and fit.k = 1
"""
