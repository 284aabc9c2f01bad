"""Reference alignments in TSV, CSV, N-Triples, alignment cells or plain RDF.

Readers give source, predicate, target as stated; canonical() makes them undirected.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.config import OWL, RDF, RDFS
from ontoloom.sources.rdf import read_triples

# Namespaces of alignment cells, with and without the mark.
CELL = "http://knowledgeweb.semanticweb.org/heterogeneity/alignment#"
CELL_BARE = CELL[:-1]
# Header names, and columns that they stand for.
HEADERS = ["srcentity", "tgtentity", "src", "tgt", "source", "target", "score", "relation"]
SOURCE_NAMES, TARGET_NAMES = ["srcentity", "src", "source"], ["tgtentity", "tgt", "target"]
# What relations mean; anything else is equivalence of classes.
RELATIONS = {"=": OWL + "equivalentClass", "equivalentclass": OWL + "equivalentClass", "equivalentproperty": OWL + "equivalentProperty", "sameas": OWL + "sameAs"}
V1_PREDICATES = [OWL + "equivalentClass", OWL + "equivalentProperty", OWL + "sameAs", RDFS + "subClassOf", RDFS + "subPropertyOf"]
EQUIVALENT = OWL + "equivalentClass"


def canonical(pairs: DataFrame) -> DataFrame:
    """Distinct, the smaller end first."""
    return pairs.select(F.least("source", "target").alias("source"), "predicate", F.greatest("source", "target").alias("target")).distinct()


def _predicate(relation):
    out = F.lit(EQUIVALENT)
    for name, predicate in RELATIONS.items():
        out = F.when(F.lower(F.trim(relation)) == name, predicate).otherwise(out)
    return out


def from_cells(rows: DataFrame, header: list[str] | None = None) -> DataFrame:
    """``rows``: cells (array of strings). Columns by the header's names, else the first two; short and blank rows go."""
    names = [h.strip().lower() for h in header or []]
    at = lambda wanted, default: next((names.index(n) for n in wanted if n in names), default)
    s, t = (at(SOURCE_NAMES, 0), at(TARGET_NAMES, 1)) if names else (0, 1)
    r = names.index("relation") if "relation" in names else None
    cell = lambda i: F.trim(F.get("cells", F.lit(i)))
    out = rows.where(F.size("cells") > max(s, t)).select(cell(s).alias("source"), (_predicate(F.coalesce(cell(r), F.lit("="))) if r is not None else F.lit(EQUIVALENT)).alias("predicate"), cell(t).alias("target"))
    return out.where("source <> '' and target <> ''")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A TSV (by suffix) or CSV file, with or without a header."""
    rows = spark.read.option("sep", "\t" if path.lower().endswith(".tsv") else ",").option("header", False).option("escape", '"').csv(path)
    if not rows.columns:
        return spark.createDataFrame([], "source string, predicate string, target string")
    first = rows.first()
    cells = rows.select(F.array(*[F.coalesce(c, F.lit("")) for c in rows.columns]).alias("cells"))
    names = [str(x or "").strip() for x in first] if first else []
    if any(n.lower() in HEADERS for n in names):
        return from_cells(cells.where(F.col("cells") != F.array(*[F.lit(x or "") for x in first])), names)
    return from_cells(cells)


LINE = r"^\s*<([^>]+)>\s+<([^>]+)>\s+<([^>]+)>\s*\.\s*$"


def from_ntriples(lines: DataFrame) -> DataFrame:
    """``lines``: line. IRI triples of any predicate; comments and literals do not count."""
    part = lambda i: F.regexp_extract("line", LINE, i)
    return lines.select(part(1).alias("source"), part(2).alias("predicate"), part(3).alias("target")).where("source <> ''")


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    return from_ntriples(spark.read.text(path).withColumnRenamed("value", "line"))


def from_cell_triples(triples: DataFrame) -> DataFrame:
    """Alignment cells: subjects with entity1 and entity2, typed cells only if there are any; relation '=' by default."""
    spaces = lambda name: [CELL + name, CELL_BARE + name]
    is_ = lambda name: F.col("predicate").isin(spaces(name))
    each = triples.groupBy("subject").agg(
        F.max((F.col("predicate") == RDF + "type") & F.col("object").isin(spaces("Cell"))).alias("typed"),
        F.min(F.when(is_("entity1"), F.col("object"))).alias("source"), F.min(F.when(is_("entity2"), F.col("object"))).alias("target"), F.min(F.when(is_("relation"), F.col("object"))).alias("relation"),
    )
    any_typed = each.agg(F.coalesce(F.max("typed"), F.lit(False)).alias("any_typed"))  # one row
    met = each.crossJoin(F.broadcast(any_typed)).where("source is not null and target is not null and (typed or not any_typed)")
    return met.select(F.trim("source").alias("source"), _predicate(F.coalesce("relation", F.lit("="))).alias("predicate"), F.trim("target").alias("target"))


def from_triples(triples: DataFrame) -> DataFrame:
    """Triples between IRIs other than types, as they are."""
    return triples.where((F.col("o_kind") == "iri") & F.col("s_is_iri") & (F.col("predicate") != RDF + "type")).select(F.col("subject").alias("source"), "predicate", F.col("object").alias("target"))


def from_triples_v1(triples: DataFrame) -> DataFrame:
    return triples.where(F.col("predicate").isin(V1_PREDICATES)).select(F.col("subject").alias("source"), "predicate", F.col("object").alias("target"))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Undirected gold: a table by its suffix, else N-Triples, else cells, else plain triples; the first that is not empty."""
    if path.lower().endswith((".tsv", ".csv")):
        return canonical(read_table(spark, path))
    found = read_ntriples(spark, path)
    if found.isEmpty():
        triples = read_triples(spark, path, onError="skip")
        found = from_cell_triples(triples)
        if found.isEmpty():
            found = from_triples(triples)
    return canonical(found)


def read_gold_v1(spark: SparkSession, path: str) -> DataFrame:
    return canonical(from_triples_v1(read_triples(spark, path, onError="skip")))


def read_directed(spark: SparkSession, path: str) -> DataFrame:
    """Distinct directed pairs: a table by its suffix; else cells, else owl:sameAs, else any IRI triple but types."""
    if path.lower().endswith((".tsv", ".csv")):
        return read_table(spark, path).select("source", "target").distinct()
    triples = read_triples(spark, path, onError="skip")
    for found in (from_cell_triples(triples), from_triples(triples).where(F.col("predicate") == OWL + "sameAs"), from_triples(triples)):
        pairs = found.select(F.trim("source").alias("source"), F.trim("target").alias("target")).distinct()
        if not pairs.isEmpty():
            return pairs
    return pairs

