"""Precision, recall and F1 of alignments against gold."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def undirected(pairs: DataFrame, a: str = "source", b: str = "target") -> DataFrame:
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _counts(system: DataFrame, gold: DataFrame, key: list[str]) -> DataFrame:
    """tp, n_system, n_gold in one row, from one grouped pass over both sets."""
    both = system.select(*key).distinct().withColumns({"s": F.lit(1), "g": F.lit(0)}).unionByName(gold.select(*key).distinct().withColumns({"s": F.lit(0), "g": F.lit(1)}))
    each = both.groupBy(*key).agg(F.max("s").alias("s"), F.max("g").alias("g"))
    return each.agg(*[F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(n) for x, n in ((F.col("s") * F.col("g"), "tp"), ("s", "n_system"), ("g", "n_gold"))])


def _metrics(counts: DataFrame) -> DataFrame:
    p, r = _ratio(F.col("tp"), F.col("n_system")), _ratio(F.col("tp"), F.col("n_gold"))
    return counts.select(F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(_f1(p, r), 4).alias("f1"), "tp", "n_system", "n_gold")


def prf(system: DataFrame, gold: DataFrame) -> DataFrame:
    """One row; pairs count in either direction and whatever their predicate; null metrics if gold is empty."""
    out = _metrics(_counts(undirected(system), undirected(gold), ["a", "b"]))
    for name in ("precision", "recall", "f1"):
        out = out.withColumn(name, F.when(F.col("n_gold") > 0, F.col(name)))
    return out


def prf_typed(system: DataFrame, gold: DataFrame) -> DataFrame:
    """One row; source, predicate and target have to agree; zeros if gold is empty."""
    flat = lambda df: df.select(F.least("source", "target").alias("a"), "predicate", F.greatest("source", "target").alias("b"))
    return _metrics(_counts(flat(system), flat(gold), ["a", "predicate", "b"]))


def prf_partial(system: DataFrame, gold: DataFrame, compat: bool = True) -> DataFrame:
    """One row for partial gold: a pair counts if gold knows its source or its target; others are ignored.

    ``compat``: as published, a target is known if it is a *source* of gold."""
    s, g = system.select("source", "target").distinct(), gold.select("source", "target").distinct()
    sources = g.select(F.col("source").alias("_s")).distinct()
    targets = g.select(F.col("source" if compat else "target").alias("_t")).distinct()
    hits = g.withColumn("_hit", F.lit(True))
    met = s.join(sources, F.col("source") == F.col("_s"), "left").join(targets, F.col("target") == F.col("_t"), "left").join(hits, ["source", "target"], "left")
    known = F.col("_s").isNotNull() | F.col("_t").isNotNull()
    count = lambda test, name: F.coalesce(F.sum(test.cast("long")), F.lit(0)).cast("long").alias(name)
    sums = met.agg(count(known & F.col("_hit").isNotNull(), "true_positives"), count(known & F.col("_hit").isNull(), "false_positives"), count(~known, "ignored"), F.count(F.lit(1)).alias("system_size"))
    sums = sums.crossJoin(g.agg(F.count(F.lit(1)).alias("reference_size")))
    tp, fp = F.col("true_positives"), F.col("false_positives")
    fn = F.col("reference_size") - tp
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return sums.select(p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1"), tp, fp, fn.alias("false_negatives"), "ignored", "system_size", (F.col("system_size") - F.col("ignored")).alias("evaluated_size"), "reference_size", F.lit("kg_partial").alias("source"))


def track_averages(report: DataFrame) -> DataFrame:
    """``report`` (track, task, precision, recall, f1, seconds) with an AVERAGE row per track and a TOTAL row of time."""
    mean = report.groupBy("track").agg(*[F.round(F.avg(c), n).alias(c) for c, n in (("precision", 4), ("recall", 4), ("f1", 4), ("seconds", 2))]).withColumns({"task": F.lit("AVERAGE"), "type": F.lit("Average")})
    none = F.lit(None).cast("double")
    total = report.agg(F.round(F.sum("seconds"), 2).alias("seconds")).withColumns({"track": F.lit("ALL"), "task": F.lit("TOTAL"), "precision": none, "recall": none, "f1": none, "type": F.lit("Summary")})
    return report.withColumn("type", F.lit("Task")).unionByName(mean).unionByName(total)
