"""From candidates to a one-to-one mapping: exact locks, filters, scores and greedy resolution."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoloom.config import Settings
from ontoloom.functions import similarity as S
from ontoloom.functions.labels import words
from ontoloom.operators.domain import threshold_of
from ontoloom.shared import discard, place_of, written

#: candidates that one task resolves; more are first thinned by rounds of mutual bests
ONE_TASK = 200_000


def exact_locks(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """source, target, etype, score 1.0: labels over two characters long that are unique for their type on both sides."""

    def unique(df: DataFrame, name: str) -> DataFrame:
        return df.where(F.length("label") > 2).groupBy("label", "etype").agg(F.count(F.lit(1)).alias("n"), F.min("uri").alias(name)).where("n = 1").drop("n")

    return unique(src, "source").join(unique(tgt, "target"), ["label", "etype"]).select("source", "target", "etype", F.lit(1.0).alias("score"))


def exact_locks_v1(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """As v1 has it: the last target of a label (by URI) takes every source of that label if their types agree."""
    last = tgt.groupBy("label").agg(F.max(F.struct("uri", "etype")).alias("t"))
    return src.join(last, "label").where(F.col("etype") == F.col("t.etype")).select(F.col("uri").alias("source"), F.col("t.uri").alias("target"), "etype", F.lit(1.0).alias("score"))


def ambiguous_labels(df: DataFrame) -> DataFrame:
    """label, etype, n of labels that more than one entity has."""
    return df.groupBy("label", "etype").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unclaimed(df: DataFrame, claims: DataFrame, side: str) -> DataFrame:
    return df.join(claims.select(F.col(side).alias("uri")), "uri", "left_anti")


def hub_discount(score: Column, freq: Column, n_src: Column, n_tgt: Column, k: Column, settings: Settings = Settings()) -> Column:
    """Targets that more sources choose than is their due count for less."""
    due = F.greatest(F.lit(settings.hub_threshold), 2.5 * n_src * k / n_tgt)
    return F.when((k > 1) & (freq > due), score * F.greatest(F.lit(settings.hub_floor), 1.0 - settings.hub_step * (freq - due))).otherwise(score)


def above_floor(score: Column, etype: Column, relaxation: float, settings: Settings = Settings()) -> Column:
    return score >= threshold_of(etype, settings) * relaxation * settings.floor_ratio


def reciprocal(fwd: Column, rev: Column, cutoff: Column, settings: Settings = Settings()) -> Column:
    """False where the reverse score is found, and far below the forward one and the cutoff."""
    return ~((fwd >= 0.75) & (rev > 0) & (rev < F.least(fwd - settings.symmetry_tolerance, 0.75 * cutoff)))


def lexical_gate(exact: Column, sem: Column, lev: Column, isub: Column, tokset: Column, wjaccard: Column, acronym: Column, settings: Settings = Settings()) -> Column:
    s = settings
    return exact | (sem >= s.sure_semantic) | (F.greatest(lev, isub, tokset) >= s.string_gate) | (wjaccard >= s.overlap_gate) | (acronym >= s.acronym_gate)


def idf_weights(labels: DataFrame) -> DataFrame:
    """etype, token, idf = ln((N + 1) / (df + 1)) + 1 of every word, stopwords too; N the labels of the type that have any."""
    told = labels.select("etype", F.array_distinct(words(F.col("label"))).alias("tokens")).where(F.size("tokens") > 0)
    # A row a type, written so that Spark knows its size: it is broadcast only where that is small.
    counts = written(told.groupBy("etype").agg(F.count(F.lit(1)).alias("n")), "types")
    df = told.select("etype", F.explode("tokens").alias("token")).groupBy("etype", "token").agg(F.count(F.lit(1)).alias("df"))
    return df.join(counts, "etype").select("etype", "token", (F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))


def label_weights(labels: DataFrame, idf: DataFrame) -> DataFrame:
    """etype, label, weights: of each distinct label the idf of its words, in the order of the sorted words; unknown words weigh 1."""
    said = labels.select("etype", "label", F.explode(F.array_distinct(words(F.col("label")))).alias("token"))
    weighed = said.distinct().join(idf, ["etype", "token"], "left").groupBy("etype", "label").agg(F.sort_array(F.collect_list(F.struct("token", F.coalesce("idf", F.lit(1.0)).alias("w")))).alias("t"))
    return weighed.select("etype", "label", F.transform("t", lambda x: x["w"]).alias("weights"))


def _sum(weights: Column) -> Column:
    return F.aggregate(weights, F.lit(0.0), lambda total, x: total + x)


def overlap(a: Column, b: Column, a_weights: Column, b_weights: Column) -> Column:
    """Weight of common words over that of all, of labels and their label_weights(); null where neither has a word."""
    sorted_words = lambda label: F.sort_array(F.array_distinct(words(label)))
    wa, wb = (F.coalesce(w, F.array().cast("array<double>")) for w in (a_weights, b_weights))
    # The weights of a's words that b has too.
    common = S._with(sorted_words(b), lambda theirs: _sum(F.zip_with(sorted_words(a), wa, lambda word, w: F.when(F.array_contains(theirs, word), w).otherwise(0.0))))
    return S._with(F.struct(common.alias("m"), (_sum(wa) + _sum(wb)).alias("n")), lambda x: F.when(x["n"] > 0, x["m"] / (x["n"] - x["m"])))


def with_weights(df: DataFrame, weights: DataFrame, label: str, name: str) -> DataFrame:
    """``df`` with the weights of its column ``label`` as ``name``, null where there are none."""
    of = weights.select(F.col("etype").alias("_etype"), F.col("label").alias("_label"), F.col("weights").alias(name))
    return df.join(of, F.col("etype").eqNullSafe(F.col("_etype")) & (F.col(label) == F.col("_label")), "left").drop("_etype", "_label")


def weighted_jaccard(pairs: DataFrame, idf: DataFrame) -> DataFrame:
    """etype, a, b (distinct labels of ``pairs``), wjaccard: weight of common words over that of all, stopwords too;
    unknown words weigh 1. Pairs without any word have no row.

    Words are joined with their weights once a label, and labels to pairs: no row is made for a word of a pair."""
    keys = pairs.select("etype", "a", "b").where("a is not null and b is not null").distinct()
    weights = label_weights(keys.select("etype", F.col("a").alias("label")).unionByName(keys.select("etype", F.col("b").alias("label"))).distinct(), idf)
    met = with_weights(with_weights(keys, weights, "a", "_wa"), weights, "b", "_wb")
    return met.select("etype", "a", "b", overlap(F.col("a"), F.col("b"), F.col("_wa"), F.col("_wb")).alias("wjaccard")).where("wjaccard is not null")


def scored_pairs(pairs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``pairs`` (source, target, etype, a, b, sem, wjaccard, a_parents, b_parents) with all partial scores and ``combined``.

    Kernels run once for each distinct pair of labels, in as many tasks as a shuffle has: pairs are short, but dear."""
    a, b = F.col("a"), F.col("b")
    lev = S.levenshtein_similarity(a, b, settings) if settings.lev_kernel == "levenshtein" else S.indel_similarity(a, b, settings)
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Dealt out before repeats go, so that this is one shuffle.
    labels = pairs.select("etype", "a", "b").repartition(tasks, "etype", "a", "b").distinct()
    told = labels.withColumns({"ngram": S.ngram_similarity(a, b), "lev": lev, "isub": S.isub_similarity(a, b), "tokset": S.token_set_similarity(a, b), "acronym": S.acronym_bonus(a, b)})
    met = pairs.join(told, ["etype", "a", "b"])
    met = met.withColumn("is_exact", (a == b) & (F.length(a) > 2)).withColumn("structural", S.structural_similarity(F.col("a_parents"), F.col("b_parents"), settings.structural_bonus) + settings.structural_bonus * F.col("acronym"))
    return met.withColumn("combined", S.combined_score(F.col("is_exact"), F.col("sem"), F.col("ngram"), F.col("lev"), F.col("isub"), F.col("structural"), settings))


def _in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of score: those whose ends are both free."""
    left, right = set(), set()
    for batch in batches:
        keep = []
        for i, (s, t) in enumerate(zip(batch.column("source").to_pylist(), batch.column("target").to_pylist(), strict=True)):
            if s not in left and t not in right:
                left.add(s)
                right.add(t)
                keep.append(i)
        yield batch.take(pa.array(keep, pa.int64()))


def greedy_one_to_one(candidates: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """The rows that a walk in order of (score descending, source, target) accepts, each end once.

    A pair that is the best left for both its ends is accepted by that walk, whatever comes before. So rounds
    accept all such pairs at once and drop what they block; once few rows are left, one task walks through them.
    """
    columns = candidates.columns
    best = F.struct(-F.col("score"), F.col("source"), F.col("target"))
    rest, accepted = candidates.withColumn("_o", best), None
    rest = written(rest.drop("_o").groupBy("source", "target").agg(F.max(F.struct("score", *[c for c in columns if c not in ("source", "target", "score")])).alias("r")).select("source", "target", "r.*"), "candidates")
    while rest.count() > one_task:
        keyed = rest.withColumn("_o", best)
        first = keyed.groupBy("source").agg(F.min("_o").alias("_s"))
        second = keyed.groupBy("target").agg(F.min("_o").alias("_t"))
        chosen = written(keyed.join(first, "source").join(second, "target").where((F.col("_o") == F.col("_s")) & (F.col("_o") == F.col("_t"))).select(*columns), "chosen")
        accepted = chosen if accepted is None else accepted.unionByName(chosen)
        before, rest = rest, written(rest.join(chosen.select("source"), "source", "left_anti").join(chosen.select("target"), "target", "left_anti").select(*columns), "candidates")
        discard(place_of(before))
    walked = rest.select(*columns).repartition(1).sortWithinPartitions(F.desc("score"), "source", "target").mapInArrow(_in_turn, candidates.schema)
    return walked if accepted is None else accepted.unionByName(walked)
