"""Sizes, the medical detector and what depends on them: number of candidates, thresholds, encoder."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontoloom.config import Settings
from ontoloom.operators.knn import nearest

# Address patterns of medical ontologies, any case.
MEDICAL_URIS = [
    r"purl\.obolibrary\.org/obo/(DOID|HP|MP|MONDO|CHEBI|NCIT|UBERON|CL|GO|PR|SYMP|VO|MA|FMA)_",
    r"snomed\.info/id/",
    r"nlm\.nih\.gov/mesh/",
    r"bioportal\.bioontology\.org/ontologies/",
    r"identifiers\.org/(doid|hp|chebi|mesh|ncit)",
]
# Words of medical labels.
MEDICAL_WORDS = [
    "disease", "syndrome", "disorder", "symptom", "phenotype", "carcinoma", "tumor",
    "neoplasm", "lesion", "infection", "pathology", "anatomy", "tissue", "organ",
    "cell", "protein", "receptor", "peptide", "amino", "molecule", "chemical",
    "compound", "pharmaceutical", "drug", "therapy", "clinical", "patient", "mutation",
]
# Parts of task names that say so.
MEDICAL_NAMES = ["anatomy", "disease", "phenotype", "human-mouse", "pharmaceutical", "med", "bio"]
SMALL = 3000


def name_is_medical(track: str, task: str) -> bool:
    return any(part in f"{track} {task}".lower() for part in MEDICAL_NAMES)


def medical_ratios(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """uri_ratio of the first 1,000 URIs (source first) and token_ratio of the first 500 labels of each side, by URI.

    The heads are the feature: a sample whose size does not depend on the ontologies."""
    both = src.select(F.lit(0).alias("side"), "uri", "label").unionByName(tgt.select(F.lit(1).alias("side"), "uri", "label"))
    pattern = "(?i)" + "|".join(MEDICAL_URIS)
    uris = both.orderBy("side", "uri").limit(1000).agg(F.avg(F.rlike("uri", F.lit(pattern)).cast("double")).alias("uri_ratio"))
    heads = src.orderBy("uri").limit(500).select("label").unionByName(tgt.orderBy("uri").limit(500).select("label"))
    said = F.array_distinct(F.filter(F.split(F.lower("label"), " "), lambda w: w != ""))
    known = F.array(*[F.lit(w) for w in MEDICAL_WORDS])
    labels = heads.agg(F.sum(F.size(F.array_intersect(said, known))).alias("m"), F.sum(F.size(said)).alias("n"))
    return uris.crossJoin(labels.select(F.when(F.col("n") > 0, F.col("m") / F.col("n")).otherwise(0.0).alias("token_ratio"))).select(F.coalesce("uri_ratio", F.lit(0.0)).alias("uri_ratio"), "token_ratio")


def is_medical(src: DataFrame, tgt: DataFrame, track: str = "", task: str = "") -> tuple[bool, str]:
    """Whether names, URIs or labels look medical, and which of them decided."""
    if name_is_medical(track, task):
        return True, "name"
    row = medical_ratios(src, tgt).first()
    if row["uri_ratio"] >= 0.05:
        return True, "uris"
    return (True, "labels") if row["token_ratio"] >= 0.03 else (False, "general")


def ontology_size(n_src: int, n_tgt: int) -> float:
    """The mean where both sides have over 100 entities, else a quarter of the sum."""
    return (n_src + n_tgt) / 2 if n_src > 100 and n_tgt > 100 else (n_src + n_tgt) / 4


def threshold_scale(size: float, total: int, medical: bool) -> float:
    factor = next((f for below, f in ((1000, 0.95), (12_500, 1.00), (50_000, 1.05), (130_000, 1.08)) if size < below), 1.18)
    return factor * ((1.12 if medical else 1.05) if total < SMALL else (1.08 if medical else 1.00))


def adaptive_k(size: float, n_src: Column, n_tgt: Column, ambiguity: Column, relaxation: float = 1.0) -> Column:
    """Candidates per source of a bucket, from the sizes of all and of the bucket; rounds half to even."""
    wide = next((k for below, k in ((10_000, 1), (50_000, 2), (130_000, 3), (400_000, 5)) if size < below), 25)
    half_even = lambda x: F.bround(x, 0).cast("int")
    local = F.greatest(F.lit(3), F.least(F.lit(50), half_even(2.0 * F.sqrt(F.greatest(n_src, n_tgt).cast("double")))))
    base = half_even(0.35 * wide + 0.65 * local)
    base = half_even(base * (1.0 + 0.6 * ambiguity))
    if relaxation < 1.0:
        base = F.floor(base * 1.3).cast("int")
    return F.least(F.greatest(F.lit(1), F.least(F.lit(150), base)), n_tgt.cast("int"))


def ambiguity(targets: DataFrame, sample: int = 64) -> DataFrame:
    """etype, ambiguity in [0, 1]: how close the best and the fifth neighbour of sampled targets are; 0 below 8 targets.

    ``targets``: uri, etype, vec. The sample, the first 64 of a type by a digest of the URI, is searched among all targets
    of its type, a sampled target among them."""
    # A window in two steps: partitions keep 64 rows of a type each before any row of a type meets the others.
    rank = F.row_number().over(Window.partitionBy("etype").orderBy(F.md5("uri"), "uri"))
    picked = targets.withColumn("_r", rank).where(F.col("_r") <= sample).drop("_r")
    near = nearest(picked, targets, 5).groupBy("etype", "source").agg(F.max("score").alias("first"), F.min("score").alias("last"))
    # At most 64 rows a type; fewer than eight of them are all that the type has.
    gaps = near.groupBy("etype").agg(F.count(F.lit(1)).alias("n"), F.avg(F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.col("first") - F.col("last")))).alias("gap"))
    return gaps.select("etype", F.when(F.col("n") < 8, 0.0).otherwise(1.0 - F.least(F.lit(1.0), F.col("gap") / 0.5)).alias("ambiguity"))


def encoder_name(total: int, medical: bool) -> tuple[str, int]:
    """Which encoder a task of so many entities takes, and its longest input in tokens."""
    if total < SMALL:
        return "BAAI/bge-m3", 64
    return ("cambridgeltl/SapBERT-from-PubMedBERT-fulltext", 128) if medical else ("sentence-transformers/all-MiniLM-L12-v2", 128)


def threshold_of(etype: Column, settings: Settings, v1: bool = False) -> Column:
    out = F.lit(settings.other_threshold)
    for name, value in (settings.thresholds_v1 if v1 else settings.thresholds).items():
        out = F.when(etype == name, value).otherwise(out)
    return out
