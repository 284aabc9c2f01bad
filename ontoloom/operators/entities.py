"""Triples to entities: type, preferred label and parents of every subject.

``triples``: subject, s_is_iri, predicate, object, o_kind (iri, literal, bnode), lang, datatype.
``entities``: uri, label, etype, parents.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoloom.config import CLASS, CONCEPT, DATATYPE_PROPERTY, INDIVIDUAL, OBJECT_PROPERTY, RDF, RDFS, SKOS, TYPES
from ontoloom.functions.labels import is_entity_uri, normalise_label, normalise_label_v1, uri_tail

LABELS = [SKOS + "prefLabel", RDFS + "label", SKOS + "altLabel"]
PARENTS = [RDFS + "subClassOf", SKOS + "broader"]
LANGS = ["en", "de", "fr"]
#: order of groups for a limit of entities
GROUPS_V1 = [CLASS, CONCEPT, OBJECT_PROPERTY, INDIVIDUAL]


def relevant(triples: DataFrame, strict: bool = True) -> DataFrame:
    """Label, type and parent triples. ``strict``: of IRI subjects, with literal labels, IRI types and IRI parents."""
    label, kind, parent = F.col("predicate").isin(LABELS), F.col("predicate") == RDF + "type", F.col("predicate").isin(PARENTS)
    if strict:
        return triples.where(F.col("s_is_iri") & (label & (F.col("o_kind") == "literal") | (kind | parent) & (F.col("o_kind") == "iri")))
    return triples.where(label | kind | parent)


def _label_rank(with_alt: bool) -> Column:
    """Language first, then predicate; then labels of any language; null: no use."""
    ranked, k = None, 0
    preferred = LABELS if with_alt else LABELS[:2]
    for lang in LANGS:
        for predicate in preferred:
            test = (F.col("lang") == lang) & (F.col("predicate") == predicate)
            ranked = F.when(test, k) if ranked is None else ranked.when(test, k)
            k += 1
    for predicate in (RDFS + "label", SKOS + "prefLabel"):
        ranked = ranked.when(F.col("predicate") == predicate, k)
        k += 1
    return ranked


def subjects(triples: DataFrame, with_alt: bool = True, merge_properties: bool = False) -> DataFrame:
    """uri, etype, raw label and parents of every subject that is typed or labelled, in one grouped pass.

    The first of CONCEPT, CLASS, OBJECT_PROPERTY, DATATYPE_PROPERTY that a subject has is its type, else
    INDIVIDUAL. Its label is the best ranked one, the smallest text at a tie, else the tail of its URI.
    """
    typed, labelled = F.col("predicate") == RDF + "type", F.col("predicate").isin(LABELS)
    rank = F.lit(None).cast("int")
    for k, t in reversed(list(enumerate(TYPES[:4]))):
        rank = F.when(typed & (F.col("object") == t), k).otherwise(rank)
    best = F.min(F.when(labelled & _label_rank(with_alt).isNotNull(), F.struct(_label_rank(with_alt).alias("rank"), F.col("object").alias("text"))))
    found = triples.groupBy(F.col("subject").alias("uri")).agg(
        F.min(rank).alias("_type"), best.alias("_best"), F.max(typed | labelled).alias("_named"),
        F.array_sort(F.collect_set(F.when(F.col("predicate").isin(PARENTS), F.col("object")))).alias("parents"),
    )
    etype = F.lit(INDIVIDUAL)
    for k, t in enumerate(TYPES[:4]):
        etype = F.when(F.col("_type") == k, t).otherwise(etype)
    if merge_properties:
        etype = F.when(etype == DATATYPE_PROPERTY, OBJECT_PROPERTY).otherwise(etype)
    return found.where("_named").select("uri", etype.alias("etype"), F.coalesce(F.col("_best.text"), uri_tail(F.col("uri"))).alias("text"), "parents")


def entities(triples: DataFrame, strict: bool = True) -> DataFrame:
    """uri, label, etype, parents: valid subjects whose label does not normalise to ''."""
    found = subjects(relevant(triples, strict)).where(is_entity_uri(F.col("uri")))
    return found.select("uri", normalise_label(F.col("text")).alias("label"), "etype", "parents").where("label <> ''")


def entities_v1(triples: DataFrame, max_entities: int | None = None) -> DataFrame:
    """As entities(), but any IRI subject is an individual at least, both kinds of property are one, labels are
    normalised by v1's rules, and there are no parents. ``max_entities``: the first so many by group, then URI."""
    every = triples.where("s_is_iri").withColumn("_any", F.lit(True))
    found = subjects(every.unionByName(every.select("subject").distinct().select(
        F.col("subject"), F.lit(True).alias("s_is_iri"), F.lit(RDF + "type").alias("predicate"), F.lit(INDIVIDUAL).alias("object"),
        F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("datatype"), F.lit(True).alias("_any"))),
        with_alt=False, merge_properties=True)
    found = found.where(is_entity_uri(F.col("uri"))).select("uri", normalise_label_v1(F.col("text")).alias("label"), "etype").where("label <> ''")
    if max_entities:
        rank = F.array_position(F.array(*[F.lit(g) for g in GROUPS_V1]), F.col("etype"))
        found = found.orderBy(rank, "uri").limit(max_entities)
    return found.withColumn("parents", F.lit(None).cast("array<string>"))


def without_parents(found: DataFrame, mean_size: int, below: int) -> DataFrame:
    """Parents cost more than they tell in very large ontologies."""
    return found if mean_size < below else found.withColumn("parents", F.lit(None).cast("array<string>"))
