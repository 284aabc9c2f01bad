"""Whole alignments: one plan over all entity types, stage after stage."""

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoloom.config import Settings
from ontoloom.operators import domain, embed, knn, resolve
from ontoloom.operators.resolve import exact_locks, exact_locks_v1, greedy_one_to_one, unclaimed
from ontoloom.shared import discard, place_of, written

PAIRS = ["source", "target", "etype", "score"]
#: what is left of the candidates where no type is on both sides
SCORED = "source string, target string, etype string, combined double"


@dataclass(frozen=True)
class Sizes:
    """Scalars that the driver plans with."""

    n_src: int
    n_tgt: int
    medical: bool

    @property
    def size(self) -> float:
        return domain.ontology_size(self.n_src, self.n_tgt)

    @property
    def total(self) -> int:
        return self.n_src + self.n_tgt


def sizes(src: DataFrame, tgt: DataFrame, settings: Settings, track: str = "", task: str = "") -> Sizes:
    medical = domain.is_medical(src, tgt, track, task)[0] if settings.medical is None else settings.medical
    return Sizes(src.count(), tgt.count(), medical)


def bucket_sizes(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """etype, n_src, n_tgt of types that both sides have."""
    count = lambda df, name: df.groupBy("etype").agg(F.count(F.lit(1)).alias(name))
    return count(src, "n_src").join(count(tgt, "n_tgt"), "etype")


def _keep(df: DataFrame, *more: str) -> DataFrame:
    out = df.select("uri", "label", "etype", *(["parents"] if "parents" in df.columns else [F.lit(None).cast("array<string>").alias("parents")]), *more)
    return out.dropDuplicates(["uri"])


def search_way(settings: Settings, buckets: DataFrame) -> str:
    """How neighbours are searched: as the settings say, or by the number of targets of the largest type."""
    if settings.search != "auto":
        return settings.search
    most = buckets.agg(F.max(F.greatest("n_src", "n_tgt"))).first()[0] or 0
    return "ivfpq" if most >= settings.pq_from else "ivf" if most >= settings.ivf_from else "exact"


def approximate(settings: Settings, way: str):
    """A search as knn.nearest(), by inverted lists, with codes in place of vectors for "ivfpq"."""

    def search(src: DataFrame, tgt: DataFrame, k: int | DataFrame) -> DataFrame:
        if tgt.isEmpty():
            return knn.nearest(src, tgt, k)
        cells = knn.centroids(tgt, ratio=settings.training_ratio)
        probes = knn.probes_of(len(cells), settings.probes_divisor)
        if way == "ivf":
            return knn.ivf_nearest(src, tgt, k, cells, probes)
        return knn.ivfpq_nearest(src, tgt, k, cells, knn.codebooks(tgt, settings.subquantizers), probes)

    return search


def candidates(src: DataFrame, tgt: DataFrame, settings: Settings, known: Sizes, relaxation: float = 1.0, vectors: DataFrame | None = None) -> DataFrame:
    """Scored candidate pairs of one stage: nearest neighbours, hub discount, floor, reciprocity, scores and gate.

    ``vectors``: label, vec of every label; without them the cosine of token sets is the semantic score, and only
    targets that reach the lowest floor are candidates.
    """
    buckets = written(bucket_sizes(src, tgt), "buckets")  # a row a type
    if buckets.isEmpty():
        return src.sparkSession.createDataFrame([], SCORED)
    if vectors is not None:
        src, tgt = (df.join(vectors, "label") for df in (src, tgt))
        unsure = domain.ambiguity(tgt) if settings.k is None else None
        way = search_way(settings, buckets)
        search = approximate(settings, way) if way != "exact" else knn.nearest
    else:
        src, tgt = embed.token_sets(src), embed.token_sets(tgt)
        # Below the lowest floor of any type no pair can pass.
        least = min([*settings.thresholds.values(), settings.other_threshold]) * relaxation * settings.floor_ratio
        way, unsure, search = "exact", None, lambda a, b, k: knn.token_nearest(a, b, k, least)
    if settings.k is not None:
        buckets = buckets.withColumn("k", F.least(F.lit(settings.k), F.col("n_tgt")).cast("int"))
    else:
        buckets = buckets.withColumn("ambiguity", F.lit(0.0)) if unsure is None else buckets.join(unsure, "etype", "left").withColumn("ambiguity", F.coalesce("ambiguity", F.lit(0.0)))
        buckets = buckets.withColumn("k", domain.adaptive_k(known.size, F.col("n_src"), F.col("n_tgt"), F.col("ambiguity"), relaxation))
    if unsure is not None:
        buckets = written(buckets, "buckets")
    limit = settings.k if settings.k is not None else buckets.select("etype", "k")
    forward = written(search(src, tgt, limit), "forward")
    found = forward.join(knn.hub_counts(forward), ["etype", "target"]).join(buckets.select("etype", "n_src", "n_tgt", "k"), "etype")
    found = found.withColumn("sem", resolve.hub_discount(F.col("score"), F.col("freq"), F.col("n_src"), F.col("n_tgt"), F.col("k"), settings))
    found = found.where(resolve.above_floor(F.col("sem"), F.col("etype"), relaxation, settings))
    if way != "exact":
        # Exact search returns the same score both ways, so only approximate search has anything to check.
        wide = F.greatest("n_src", "n_tgt") >= settings.wide_reverse_from
        back = knn.reverse_nearest(src, tgt, forward, buckets.select("etype", F.least(F.when(wide, settings.wide_reverse).otherwise(F.col("k")), F.col("n_src")).cast("int").alias("k")), search=search)
        found = knn.with_reverse(found, back)
        cutoff = domain.threshold_of(F.col("etype"), settings) * relaxation
        found = found.where(resolve.reciprocal(F.col("sem"), F.col("rev"), cutoff, settings))
    # Words are weighed once a label, before pairs are made, so that no row is made for a word of a pair.
    entities = src.select("etype", "label").unionByName(tgt.select("etype", "label"))
    weights = resolve.label_weights(entities.distinct(), resolve.idf_weights(entities))
    side = lambda df, uri, label: resolve.with_weights(df, weights, "label", f"_{label}").select(F.col("uri").alias(uri), F.col("label").alias(label), F.col("parents").alias(f"{label}_parents"), f"_{label}")
    met = found.select("source", "target", "etype", "sem").join(side(src, "source", "a"), "source").join(side(tgt, "target", "b"), "target")
    wjaccard = F.coalesce(resolve.overlap(F.col("a"), F.col("b"), F.col("_a"), F.col("_b")), F.lit(0.0))
    # Written, as labels and scores both read it.
    pairs = written(met.withColumn("wjaccard", wjaccard).drop("_a", "_b"), "pairs")
    discard(place_of(forward))
    scored = resolve.scored_pairs(pairs, settings)
    return scored.where(resolve.lexical_gate(F.col("is_exact"), F.col("sem"), F.col("lev"), F.col("isub"), F.col("tokset"), F.col("wjaccard"), F.col("acronym"), settings))


def stage(src: DataFrame, tgt: DataFrame, claims: DataFrame, settings: Settings, known: Sizes, relaxation: float, vectors: DataFrame | None = None) -> DataFrame:
    """The one-to-one pairs that a stage adds to ``claims``."""
    scale = domain.threshold_scale(known.size, known.total, known.medical)
    found = candidates(unclaimed(src, claims, "source"), unclaimed(tgt, claims, "target"), settings, known, relaxation, vectors)
    need = domain.threshold_of(F.col("etype"), settings) * (scale * relaxation)
    return greedy_one_to_one(found.where(F.col("combined") >= need).select("source", "target", "etype", F.col("combined").alias("score")))


def align(src: DataFrame, tgt: DataFrame, settings: Settings = Settings(), vectors: DataFrame | None = None, track: str = "", task: str = "", known: Sizes | None = None) -> DataFrame:
    """source, target, etype, score (4 decimals): unique sources, unique targets.

    ``src``, ``tgt``: uri, label, etype and maybe parents; of rows that share a URI one counts.
    """
    if settings.profile == "v1":
        return align_v1(src, tgt, settings, vectors)
    src, tgt = written(_keep(src), "source"), written(_keep(tgt), "target")
    vectors = None if vectors is None else written(vectors, "vectors")
    known = known or sizes(src, tgt, settings, track, task)
    claims = written(exact_locks(src, tgt), "claims")
    relaxations = [1.0, settings.second_stage] if known.size < settings.second_stage_below else [1.0]
    for relaxation in relaxations:
        claims = claims.unionByName(written(stage(src, tgt, claims, settings, known, relaxation, vectors), "claims"))
    return claims.select("source", "target", "etype", F.round("score", 4).alias("score"))


def lengths_fit(a: Column, b: Column) -> Column:
    """v1's filter: lengths differ by at most 0.6 of the longer one."""
    return F.abs(F.length(a) - F.length(b)) <= 0.6 * F.greatest(F.length(a), F.length(b))


def align_v1(src: DataFrame, tgt: DataFrame, settings: Settings = Settings(), vectors: DataFrame | None = None) -> DataFrame:
    """The first version: exact labels, then the one best target of each source above its type's threshold, greedily."""
    src, tgt = written(_keep(src), "source"), written(_keep(tgt), "target")
    vectors = None if vectors is None else written(vectors, "vectors")
    claims = written(exact_locks_v1(src, tgt), "claims")
    rest_s, rest_t = unclaimed(src, claims, "source"), unclaimed(tgt, claims, "target")
    if vectors is None:
        least = min([*settings.thresholds_v1.values(), settings.other_threshold])
        best = knn.token_nearest(embed.token_sets(rest_s), embed.token_sets(rest_t), 1, least)
    else:
        best = knn.nearest(rest_s.join(vectors, "label"), rest_t.join(vectors, "label"), 1)
    labels = best.join(rest_s.select(F.col("uri").alias("source"), F.col("label").alias("a")), "source").join(rest_t.select(F.col("uri").alias("target"), F.col("label").alias("b")), "target")
    found = labels.where((F.col("score") >= domain.threshold_of(F.col("etype"), settings, v1=True)) & lengths_fit(F.col("a"), F.col("b"))).select(*PAIRS)
    return claims.unionByName(greedy_one_to_one(found))


def with_thresholds(settings: Settings, **changes) -> Settings:
    return replace(settings, **changes)
