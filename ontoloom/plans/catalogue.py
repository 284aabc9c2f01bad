"""Named queries over the test tables, each over its whole tables, with the same result in DuckDB SQL.

``documents`` stands for two ontologies (even doc_ids: source, odd: target; label: the normalised text,
etype: lang, parents: the source), ``embeddings`` for encoded entities, ``part`` for ambiguous labels,
and triples are made from nation, region, supplier and documents.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ontoloom.config import CONCEPT, OWL, RDF, RDFS, SKOS, Settings
from ontoloom.functions import labels as L
from ontoloom.functions import pairwise as P
from ontoloom.functions import similarity as S
from ontoloom.functions import vectors as V
from ontoloom.operators import domain, embed, entities, evaluate, knn, pairs, resolve
from ontoloom.plans import align as A
from ontoloom.shared import written
from ontoloom.sources import gold, sinks

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# --- shared frames and their SQL ---------------------------------------------------------------------

STOP_SQL = "[" + ",".join(f"'{w}'" for w in L.STOPWORDS) + "]"


def norm_sql(x: str) -> str:
    for p in L.PREFIXES:
        x = f"(case when starts_with({x}, '{p}') then substr({x}, {len(p) + 1}) else {x} end)" if len(x) < 60 else f"regexp_replace({x}, '^{p}', '')"
    x = f"regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
    x = f"regexp_replace(regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g'), '[^a-zA-Z0-9]', ' ', 'g')"
    return f"array_to_string(list_filter(string_split(lower({x}), ' '), lambda w: w <> '')[1:20], ' ')"


NORM = norm_sql("coalesce(text, '')")
ENT_SQL = f"ent as (select doc_id::varchar as uri, {NORM} as label, lang as etype, source as parent, doc_id % 2 as side from documents), e as (select * from ent where label <> '')"
TOK = lambda x: f"list_distinct(list_filter(string_split({x}, ' '), lambda w: w <> '' and not list_contains({STOP_SQL}, w)))"
WORDS = lambda x: f"list_distinct(list_filter(string_split({x}, ' '), lambda w: w <> ''))"
JAC = lambda a, b: f"(case when len({a}) = 0 or len({b}) = 0 then 0.0 else len(list_intersect({a}, {b}))::double / len(list_distinct(list_concat({a}, {b}))) end)"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def doc_entities(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("uri"), L.normalise_label(F.col("text")).alias("label"), F.col("lang").alias("etype"), F.array("source").alias("parents"), (F.col("doc_id") % 2).alias("side")).where("label <> ''")


def sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where("side = 0").drop("side"), df.where("side = 1").drop("side")


def vec_entities(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("uri"), F.col("label").cast("string").alias("etype"), F.col("embedding").alias("vec"), (F.col("vec_id") % 2).alias("side"))
    return sides(v)


def pair_scores(spark: SparkSession, sf: str, kernels: dict[str, pairs.Kernel], weigh: bool = False) -> DataFrame:
    """All pairs of a source and a target label of one language that share one of the eight rarest words of both, scored."""
    e = doc_entities(spark, sf).select("etype", "side", "label")
    if not weigh:
        return pairs.scored(e, kernels)
    e = written(e, "entities")  # read for the pairs, and twice for the weights
    return pairs.scored(e, kernels, idf=resolve.idf_weights(e))


PAIR_SQL = f"""{ENT_SQL}, said as (select etype, side, label, unnest({WORDS("label")}) as token from (select distinct etype, side, label from e)),
rare as (select * from (select *, row_number() over (partition by etype, side, label order by df, token) as rn from said join (select etype, token, count(*) as df from said group by all) using (etype, token)) where rn <= 8),
pairs as (select distinct s.etype, s.label as a, t.label as b from rare s join rare t using (etype, token) where s.side = 0 and t.side = 1)"""

DOT = "list_dot_product(s.embedding::double[], t.embedding::double[])"
VEC_SQL = """v as (select vec_id::varchar as uri, label::varchar as etype, embedding, vec_id % 2 as side from embeddings)"""


def knn_sql(k: int) -> str:
    return f"""{VEC_SQL}, p as (select s.etype, s.uri as source, t.uri as target, {DOT} as score from v s join v t on s.etype = t.etype and s.side = 0 and t.side = 1),
r as (select *, row_number() over (partition by etype, source order by score desc, target) as rank from p), fwd as (select * from r where rank <= {k})"""


REV_SQL = """, q as (select p.*, row_number() over (partition by etype, target order by score desc, source) as rk from p where target in (select target from fwd)),
rev as (select source, target, score as rev_score, rk as rev_rank from q where rk <= 3)"""
BUCKET_SQL = ", b as (select etype, count(*) filter (side = 0) as n_src, count(*) filter (side = 1) as n_tgt from v group by etype)"
HUB_SQL = """, f as (select etype, target, count(*) as freq from fwd group by all),
h as (select fwd.*, freq, case when freq > greatest(2.0, 0.5 * n_src * 3 / n_tgt) then score * greatest(0.65, 1.0 - 0.03 * (freq - greatest(2.0, 0.5 * n_src * 3 / n_tgt))) else score end as sem
  from fwd join f using (etype, target) join b using (etype))"""


def triples(spark: SparkSession, sf: str) -> DataFrame:
    """subject, s_is_iri, predicate, object, o_kind, lang, datatype from nation, region, supplier and documents."""
    t = lambda df, s, p, o, kind, lang=None: df.select(s.alias("subject"), F.lit(True).alias("s_is_iri"), F.lit(p).alias("predicate"), o.alias("object"), F.lit(kind).alias("o_kind"), (F.lit(lang).cast("string") if lang is None or isinstance(lang, str) else lang).alias("lang"), F.lit(None).cast("string").alias("datatype"))
    n, r, s, d = (table(spark, sf, x) for x in ("nation", "region", "supplier", "documents"))
    uri = lambda kind, key: F.concat(F.lit(f"http://ex.org/{kind}#"), F.col(key).cast("string"))
    nation, region, supplier, doc = uri("nation", "n_nationkey"), uri("region", "r_regionkey"), uri("supplier", "s_suppkey"), uri("doc", "doc_id")
    parts = [
        t(n, nation, RDF + "type", F.lit(OWL + "Class"), "iri"), t(n, nation, RDFS + "label", F.col("n_name"), "literal", "en"),
        t(n, nation, RDFS + "subClassOf", F.concat(F.lit("http://ex.org/region#"), F.col("n_regionkey").cast("string")), "iri"),
        t(r, region, RDF + "type", F.lit(OWL + "Class"), "iri"), t(r, region, RDF + "type", F.lit(SKOS + "Concept"), "iri"), t(r, region, SKOS + "prefLabel", F.col("r_name"), "literal", "es"),
        t(s, supplier, RDFS + "label", F.col("s_name"), "literal"), t(s, supplier, SKOS + "altLabel", F.concat(F.lit("alias "), F.col("s_name")), "literal", "de"),
        t(d, doc, SKOS + "prefLabel", F.col("text"), "literal", F.col("lang")), t(d, doc, RDFS + "label", F.expr("substring(text, 5)"), "literal", "en"),
        t(d.where("doc_id % 3 = 0"), doc, RDF + "type", F.lit(OWL + "ObjectProperty"), "iri"), t(d.where("doc_id % 3 = 1"), doc, RDF + "type", F.lit(OWL + "DatatypeProperty"), "iri"),
        t(d, doc, SKOS + "broader", F.concat(F.lit("http://ex.org/source#"), F.col("source")), "iri"),
        t(d.where("doc_id % 5 = 0"), F.concat(F.lit(OWL), F.col("doc_id").cast("string")), RDFS + "label", F.lit("reserved"), "literal", "en"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _t(source: str, subject: str, p: str, o: str, kind: str, lang: str = "null") -> str:
    return f"select {subject} as subject, '{p}' as predicate, {o} as object, '{kind}' as o_kind, {lang}::varchar as lang from {source}"


TRIPLES_SQL = "triples as (" + " union all ".join([
    _t("nation", "'http://ex.org/nation#' || n_nationkey", RDF + "type", f"'{OWL}Class'", "iri"), _t("nation", "'http://ex.org/nation#' || n_nationkey", RDFS + "label", "n_name", "literal", "'en'"),
    _t("nation", "'http://ex.org/nation#' || n_nationkey", RDFS + "subClassOf", "'http://ex.org/region#' || n_regionkey", "iri"),
    _t("region", "'http://ex.org/region#' || r_regionkey", RDF + "type", f"'{OWL}Class'", "iri"), _t("region", "'http://ex.org/region#' || r_regionkey", RDF + "type", f"'{SKOS}Concept'", "iri"),
    _t("region", "'http://ex.org/region#' || r_regionkey", SKOS + "prefLabel", "r_name", "literal", "'es'"),
    _t("supplier", "'http://ex.org/supplier#' || s_suppkey", RDFS + "label", "s_name", "literal"), _t("supplier", "'http://ex.org/supplier#' || s_suppkey", SKOS + "altLabel", "'alias ' || s_name", "literal", "'de'"),
    _t("documents", "'http://ex.org/doc#' || doc_id", SKOS + "prefLabel", "text", "literal", "lang"), _t("documents", "'http://ex.org/doc#' || doc_id", RDFS + "label", "substr(text, 5)", "literal", "'en'"),
    _t("documents where doc_id % 3 = 0", "'http://ex.org/doc#' || doc_id", RDF + "type", f"'{OWL}ObjectProperty'", "iri"), _t("documents where doc_id % 3 = 1", "'http://ex.org/doc#' || doc_id", RDF + "type", f"'{OWL}DatatypeProperty'", "iri"),
    _t("documents", "'http://ex.org/doc#' || doc_id", SKOS + "broader", "'http://ex.org/source#' || source", "iri"),
    _t("documents where doc_id % 5 = 0", f"'{OWL}' || doc_id", RDFS + "label", "'reserved'", "literal", "'en'"),
]) + ")"
TYPED_SQL = f"""{TRIPLES_SQL}, ty as (select subject, min(case object when '{SKOS}Concept' then 0 when '{OWL}Class' then 1 when '{OWL}ObjectProperty' then 2 when '{OWL}DatatypeProperty' then 3 end) as k
 from triples where predicate in ('{RDF}type', '{RDFS}label', '{SKOS}prefLabel', '{SKOS}altLabel') group by subject)"""
NAME_SQL = f"case k when 0 then '{SKOS}Concept' when 1 then '{OWL}Class' when 2 then '{OWL}ObjectProperty' when 3 then '{OWL}DatatypeProperty' else '{OWL}NamedIndividual' end"
RANK_SQL = f"""case when lang in ('en','de','fr') then (case lang when 'en' then 0 when 'de' then 3 else 6 end) + (case predicate when '{SKOS}prefLabel' then 0 when '{RDFS}label' then 1 else 2 end)
 when predicate = '{RDFS}label' then 9 when predicate = '{SKOS}prefLabel' then 10 end"""
LABEL_SQL = f"""lb as (select subject, object as text, row_number() over (partition by subject order by {RANK_SQL}, object) as rn from triples
 where predicate in ('{RDFS}label', '{SKOS}prefLabel', '{SKOS}altLabel') and ({RANK_SQL}) is not null)"""


# --- labels and entities --------------------------------------------------------------------------------


@query("q01_normalise_label_v2", f"select doc_id, {NORM} as label from documents")
def q01(spark, sf):
    return table(spark, sf, "documents").select("doc_id", L.normalise_label(F.col("text")).alias("label"))


CAMEL = "concat(upper(substr(p_name,1,1)), substr(p_name,2), p_brand)"


@query("q02_normalise_label_v1", f"""with x as (select 'd' || doc_id as id, text from documents union all select 'p' || p_partkey, {CAMEL} from part)
select id, array_to_string(list_filter(regexp_split_to_array(lower(translate(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '_-', '  ')), '\\s+'), lambda w: w <> '')[1:15], ' ') as label from x""")
def q02(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    p = table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.expr(CAMEL).alias("text"))
    return d.unionByName(p).select("id", L.normalise_label_v1(F.col("text")).alias("label"))


@query("q03_uri_tail", "select page_id, regexp_replace(list_extract(string_split(list_extract(string_split(url, '/'), -1), '#'), -1), '%[0-9A-Fa-f]{2}', ' ', 'g') as tail from pages")
def q03(spark, sf):
    return table(spark, sf, "pages").select("page_id", L.uri_tail(F.col("url")).alias("tail"))


SNIFFED = ["<?xml version='1.0'?><rdf:RDF/>", "Prefix(:=<http://x#>)\nOntology(<http://x>)", "Ontology: <http://x>\nClass: A", "@prefix owl: <http://x#> .", "\n<http://x/a> a <http://x/b> .", "nothing of the kind", ""]


@query("q04_sniff_format", "with x as (select 'p' || page_id as id, html as t from pages union all select * from (values " + ", ".join(f"('l{i}', '{t.replace(chr(39), chr(39) * 2)}')" for i, t in enumerate(SNIFFED)) + r""")),
h as (select id, substr(t, 1, 8192) as t, substr(t, 1, 2048) as f from x)
select id, case when regexp_matches(f, '<\?xml|<rdf:RDF|<Ontology[\s>]') then 'rdfxml' when regexp_matches(f, '\b(Ontology|Prefix|Declaration|SubClassOf|EquivalentClasses|AnnotationAssertion)\s*\(') then 'functional'
 when regexp_matches(t, '(?m)^\s*(Ontology|Class|ObjectProperty)\s*:') then 'manchester' when regexp_matches(t, '^\s*(@prefix|@base|PREFIX|BASE)') or regexp_matches(t, '(?m)^\s*<[^>]+>\s+a\s+') then 'turtle' else 'unknown' end as format from h""")
def q04(spark, sf):
    rows = spark.createDataFrame([(f"l{i}", t) for i, t in enumerate(SNIFFED)], "id string, t string")
    x = table(spark, sf, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.col("html").alias("t")).unionByName(rows)
    return x.select("id", L.sniffed_format(F.substring("t", 1, 8192)).alias("format"))


@query("q05_entity_type_resolution", f"with {TYPED_SQL} select subject as uri, {NAME_SQL} as etype from ty")
def q05(spark, sf):
    return entities.subjects(entities.relevant(triples(spark, sf))).select("uri", "etype")


@query("q06_preferred_label", f"with {TRIPLES_SQL}, {LABEL_SQL} select subject as uri, text from lb where rn = 1")
def q06(spark, sf):
    return entities.subjects(entities.relevant(triples(spark, sf))).select("uri", "text")


@query("q07_valid_uri_filter", "with x as (select url as uri from pages union all select * from (values ('http://www.w3.org/2002/07/owl#Thing'), ('http://x/oboInOwl#y'), ('http://www.w3.org/2004/02/skos/core#a'), ('http://ok.org/a'))) select uri from x where not contains(uri, 'oboInOwl') and not starts_with(uri, 'http://www.w3.org/2002/07/owl#') and not starts_with(uri, 'http://www.w3.org/2004/02/skos/core#') and not starts_with(uri, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#') and not starts_with(uri, 'http://www.w3.org/2000/01/rdf-schema#')")
def q07(spark, sf):
    more = spark.createDataFrame([("http://www.w3.org/2002/07/owl#Thing",), ("http://x/oboInOwl#y",), ("http://www.w3.org/2004/02/skos/core#a",), ("http://ok.org/a",)], "uri string")
    return table(spark, sf, "pages").select(F.col("url").alias("uri")).unionByName(more).where(L.is_entity_uri(F.col("uri")))


@query("q08_parent_sets", f"with {TRIPLES_SQL} select subject as uri, string_agg(distinct object, ',' order by object) as parents from triples where predicate in ('{RDFS}subClassOf', '{SKOS}broader') group by subject")
def q08(spark, sf):
    return entities.subjects(entities.relevant(triples(spark, sf))).where("size(parents) > 0").select("uri", F.array_join("parents", ",").alias("parents"))


LOCK_SQL = """lock as (select s.uri as source, t.uri as target, s.etype from
 (select label, etype, min(uri) as uri from e where side = 0 and length(label) > 2 group by all having count(*) = 1) s join
 (select label, etype, min(uri) as uri from e where side = 1 and length(label) > 2 group by all having count(*) = 1) t using (label, etype))"""


@query("q09_exact_prelock", f"with {ENT_SQL}, {LOCK_SQL} select source, target, etype, 1.0::double as score from lock")
def q09(spark, sf):
    return resolve.exact_locks(*sides(doc_entities(spark, sf)))


def part_entities(spark, sf):
    p = table(spark, sf, "part")
    return sides(p.select(F.col("p_partkey").cast("string").alias("uri"), F.col("p_name").alias("label"), F.col("p_brand").alias("etype"), F.array("p_brand", "p_type").alias("parents"), (F.col("p_partkey") % 2).alias("side")))


PART_SQL = "p as (select p_partkey::varchar as uri, p_name as label, p_brand as etype, p_type, p_partkey % 2 as side from part)"


@query("q10_exact_prelock_v1", f"with {PART_SQL}, t as (select label, max(uri) as target from p where side = 1 group by label) select s.uri as source, t.target, s.etype, 1.0::double as score from p s join t using (label) join p q on q.uri = t.target where s.side = 0 and s.etype = q.etype")
def q10(spark, sf):
    return resolve.exact_locks_v1(*part_entities(spark, sf))


@query("q11_ambiguous_labels", f"with {PART_SQL} select label, etype, count(*) as n from p where side = 0 group by all having count(*) > 1")
def q11(spark, sf):
    return resolve.ambiguous_labels(part_entities(spark, sf)[0])


@query("q12_claimed_antijoin", f"with {ENT_SQL}, {LOCK_SQL} select uri, label, etype from e where side = 0 and uri not in (select source from lock)")
def q12(spark, sf):
    s, t = sides(doc_entities(spark, sf))
    return resolve.unclaimed(s, resolve.exact_locks(s, t), "source").select("uri", "label", "etype")


# --- neighbours ------------------------------------------------------------------------------------------


@query("q13_knn_forward", f"with {knn_sql(3)} select etype, source, target, round(score, 4) as score, rank from fwd")
def q13(spark, sf):
    return knn.nearest(*vec_entities(spark, sf), 3).withColumn("score", F.round("score", 4)).withColumn("rank", F.col("rank").cast("long"))


def _both(spark, sf):
    s, t = vec_entities(spark, sf)
    fwd = knn.nearest(s, t, 3)
    return s, t, fwd, knn.reverse_nearest(s, t, fwd, 3)


@query("q14_knn_reverse", f"with {knn_sql(3)}{REV_SQL} select source, target, round(rev_score, 4) as rev_score, rev_rank from rev")
def q14(spark, sf):
    return _both(spark, sf)[3].select("source", "target", F.round("rev_score", 4).alias("rev_score"), F.col("rev_rank").cast("long").alias("rev_rank"))


@query("q15_reciprocal_left_join", f"with {knn_sql(3)}{REV_SQL} select fwd.source, fwd.target, round(score, 4) as score, round(coalesce(rev_score, 0), 4) as rev, not (score >= 0.75 and coalesce(rev_score, 0) > 0 and coalesce(rev_score, 0) < least(score - 0.2, 0.75 * 0.8)) as kept from fwd left join rev using (source, target)")
def q15(spark, sf):
    _, _, fwd, rev = _both(spark, sf)
    met = knn.with_reverse(fwd, rev)
    return met.select("source", "target", F.round("score", 4).alias("score"), F.round("rev", 4).alias("rev"), resolve.reciprocal(F.col("score"), F.col("rev"), F.lit(0.8)).alias("kept"))


@query("q16_top1_v1", f"with {knn_sql(1)} select source, target, etype, round(score, 4) as score from fwd where score >= 0.15")
def q16(spark, sf):
    return knn.nearest(*vec_entities(spark, sf), 1).where("score >= 0.15").select("source", "target", "etype", F.round("score", 4).alias("score"))


@query("q17_hub_frequency", f"with {knn_sql(3)} select etype, target, count(*) as freq from fwd group by all")
def q17(spark, sf):
    return knn.hub_counts(knn.nearest(*vec_entities(spark, sf), 3))


def _discounted(spark, sf):
    s, t = vec_entities(spark, sf)
    fwd = knn.nearest(s, t, 3)
    met = fwd.join(knn.hub_counts(fwd), ["etype", "target"]).join(A.bucket_sizes(s, t), "etype")
    # A lower due than the default's, so that the small tables have hubs: 0.5 for 2.5 comes from k / 5.
    due = Settings(hub_threshold=2.0)
    return met.withColumn("sem", F.when(F.col("freq") > F.greatest(F.lit(2.0), 0.5 * F.col("n_src") * 3 / F.col("n_tgt")), resolve.hub_discount(F.col("score"), F.col("freq"), F.col("n_src") / 5.0, F.col("n_tgt"), F.lit(3), due)).otherwise(F.col("score")))


@query("q18_hub_discount", f"with {knn_sql(3)}{BUCKET_SQL}{HUB_SQL} select source, target, freq, round(sem, 4) as sem from h")
def q18(spark, sf):
    return _discounted(spark, sf).select("source", "target", "freq", F.round("sem", 4).alias("sem"))


@query("q19_semantic_floor", f"with {knn_sql(3)}{BUCKET_SQL}{HUB_SQL} select source, target, round(sem, 4) as sem from h where sem >= 0.25 * 0.92 * 0.72")
def q19(spark, sf):
    low = Settings(other_threshold=0.25)
    return _discounted(spark, sf).where(resolve.above_floor(F.col("sem"), F.col("etype"), 0.92, low)).select("source", "target", F.round("sem", 4).alias("sem"))


# --- similarities of label pairs ---------------------------------------------------------------------------

GRAMS = lambda x, n: f"(case when length({x}) < {n} then []::varchar[] else list_distinct(list_transform(range(1, greatest(length({x}) - {n - 1}, 1) + 1), lambda i: substr({x}, i, {n}))) end)"
NGRAM_SQL = f"(case when a = b then 1.0 when least(length(a), length(b)) >= 3 then {JAC(GRAMS('a', 3), GRAMS('b', 3))} else {JAC(GRAMS('a', 2), GRAMS('b', 2))} end)"
RAW_LEV = "(case when abs(length(a) - length(b)) > 0.4 * greatest(length(a), length(b)) then 0.0 else 1.0 - levenshtein(a, b)::double / greatest(length(a), length(b)) end)"
LEV_SQL = f"(case when a = b then 1.0 when a = '' or b = '' or greatest(length(a), length(b)) > 2.5 * least(length(a), length(b)) then 0.0 when least(length(a), length(b)) <= 3 and {RAW_LEV} < 1.0 then {RAW_LEV} * 0.4 when least(length(a), length(b)) between 4 and 5 and {RAW_LEV} < 0.88 then {RAW_LEV} * 0.7 else {RAW_LEV} end)"
TOKSET_SQL = JAC(TOK("a"), TOK("b"))
SEM_SQL = f"(case when len({WORDS('a')}) = 0 or len({WORDS('b')}) = 0 then 0.0 else len(list_intersect({WORDS('a')}, {WORDS('b')}))::double / sqrt(len({WORDS('a')})::double * len({WORDS('b')})) end)"


# The longest common substring of l and r, earliest in l, taken out of both: six times. Starts that no pair of letters
# shares are passed over, and each start's longest run is looked for among the lengths that beat none.
_RUNS = "list_filter(list_transform(range(1, length(l)), lambda i: {'n': list_max(list_filter(range(1, length(l) - i + 2), lambda n: contains(r, substr(l, i, n)))), 'i': -i}), lambda x: x.n >= 2)"


def isub_sql(source: str) -> str:
    """CTEs that end in isub(a, b, isub) over the distinct a and b of ``source``."""
    fits = "least(a, b) <> greatest(a, b) and least(length(a), length(b)) > 0 and greatest(length(a), length(b)) <= 2.5 * least(length(a), length(b))"
    out = f"is0 as (select distinct a, b, least(a, b) as l, greatest(a, b) as r, 0 as common from {source} where {fits})"
    for k in range(6):
        out += f""", ib{k} as (select *, list_max({_RUNS}) as m from is{k}),
is{k + 1} as (select a, b, case when m is null then l else substr(l, 1, -m.i - 1) || substr(l, -m.i + m.n) end as l,
  case when m is null then r else substr(r, 1, position(substr(l, -m.i, m.n) in r) - 1) || substr(r, position(substr(l, -m.i, m.n) in r) + m.n) end as r, common + coalesce(m.n, 0) as common from ib{k})"""
    whole = "(length(a) + length(b))"
    score = f"2.0 * common / {whole} - 0.3::double * (length(l)::double / length(least(a, b))) * (length(r)::double / length(greatest(a, b)))"
    return out + f""", iscore as (select a as xa, b as xb, case when common = 0 then 0.0 else least(1.0, greatest(0.0, {score})) end::double as x from is6),
isub as (select distinct p.a as a, p.b as b, case when p.a = p.b then 1.0 else coalesce(x, 0.0) end::double as isub from {source} p left join iscore on p.a = xa and p.b = xb)"""


# Rows of the table of longest common subsequences, a letter of b at a time; a row is the running maximum of what each
# letter of a gives.
_LCS = "list_reduce(list_prepend(list_transform(range(0, length(a) + 1), lambda z: 0), list_transform(string_split(b, ''), lambda c: list_transform(range(0, length(a) + 1), lambda j: case when j > 0 and substr(a, j, 1) = c then 1 else 0 end))), lambda row, hit: list_reduce(list_prepend([0], list_transform(range(2, length(a) + 2), lambda j: [greatest(row[j], case when hit[j] = 1 then row[j - 1] + 1 else 0 end)])), lambda x, y: list_append(x, greatest(x[-1], y[1]))))"
_RAW_INDEL = f"(2.0 * list_last({_LCS}) / (length(a) + length(b)))"


def indel_sql(source: str) -> str:
    """A CTE indel(a, b, indel) over the distinct a and b of ``source``."""
    return f"""raw as (select distinct a, b, case when a = b then 1.0 when a = '' or b = '' or greatest(length(a), length(b)) > 2.5 * least(length(a), length(b)) then 0.0 else {_RAW_INDEL} end::double as x from {source}),
indel as (select a, b, case when x = 0 or x = 1 then x when least(length(a), length(b)) <= 3 then x * 0.4::double when least(length(a), length(b)) <= 5 and x < 0.88 then x * 0.7::double else x end as indel from raw)"""


def _plain(kernel) -> pairs.Kernel:
    """A kernel that weighs no words."""
    return lambda s, t, i, j, weights: kernel(s, t, i, j)


def _pair_query(name: str, column: str, kernel, sql: str | None):
    @query(name, f"with {PAIR_SQL} select etype, a, b, round({sql}, 6) as {column} from pairs" if sql else None)
    def run(spark, sf):
        return pair_scores(spark, sf, {column: _plain(kernel)}).withColumn(column, F.round(column, 6))

    return run


_pair_query("q20_ngram_similarity", "ngram", P.ngram, NGRAM_SQL)
_pair_query("q21_levenshtein_damped", "lev", P.levenshtein, LEV_SQL)


@query("q22_indel_ratio", f"with {PAIR_SQL}, {indel_sql('pairs')} select etype, a, b, round(indel, 6) as indel from pairs join indel using (a, b)")
def q22(spark, sf):
    return pair_scores(spark, sf, {"indel": _plain(P.indel)}).withColumn("indel", F.round("indel", 6))


@query("q23_isub", f"with {PAIR_SQL}, {isub_sql('pairs')} select etype, a, b, round(isub, 6) as isub from pairs join isub using (a, b)")
def q23(spark, sf):
    return pair_scores(spark, sf, {"isub": _plain(P.isub)}).withColumn("isub", F.round("isub", 6))


_pair_query("q24_token_set_jaccard", "tokset", P.token_set, TOKSET_SQL)


ACRO = [("www", "world wide web"), ("oae", "ontology alignment evaluation initiative"), ("un", "united nations"), ("xy", "united nations"), ("bo", "bank of england"), ("boe", "bank of england"), ("a", "alpha beta"), ("ab", "alphabeta")]


@query("q25_acronym", "with x as (select p_name as a, array_to_string(list_transform(string_split(p_name, ' '), lambda w: substr(w, 1, 1)), '') as b from part union select * from (values " + ", ".join(f"('{b}', '{a}')" for a, b in ACRO) + f""")),
o as (select a as l0, b as s0, lower(case when length(b) <= length(a) then b else a end) as s, lower(case when length(b) <= length(a) then a else b end) as l from x),
w as (select *, replace(s, ' ', '') as sh, list_filter(string_split(l, ' '), lambda w: w <> '') as every, list_filter(string_split(l, ' '), lambda w: w <> '' and not list_contains({STOP_SQL}, w)) as telling from o),
i as (select *, array_to_string(list_transform(case when len(telling) >= 2 then telling else every end, lambda w: substr(w, 1, 1)), '') as ini from w)
select l0 as a, s0 as b, case when length(sh) not between 2 and 8 or not contains(l, ' ') then 0.0 when sh = ini then 1.0 when length(sh) >= 3 and starts_with(ini, sh) then 0.8 else 0.0 end::double as bonus from i""")
def q25(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_name").alias("a"), F.array_join(F.transform(F.split("p_name", " "), lambda w: F.substring(w, 1, 1)), "").alias("b"))
    x = p.unionByName(spark.createDataFrame([(b, a) for a, b in ACRO], "a string, b string")).distinct()
    return x.select("a", "b", S.acronym_bonus(F.col("b"), F.col("a")).alias("bonus"))


IDF_SQL = f"""tk as (select etype, {WORDS("label")} as t from e), tn as (select etype, count(*) as n from tk where len(t) > 0 group by etype),
idf as (select etype, token, ln((n + 1.0) / (count(*) + 1.0)) + 1.0 as idf from (select etype, unnest(t) as token from tk) join tn using (etype) group by etype, token, n)"""


@query("q26_idf", f"with {ENT_SQL}, {IDF_SQL} select etype, token, round(idf, 6) as idf from idf")
def q26(spark, sf):
    return resolve.idf_weights(doc_entities(spark, sf)).withColumn("idf", F.round("idf", 6))


WJAC_SQL = f"""pt as (select etype, a, b, {WORDS("a")} as ta, {WORDS("b")} as tb from pairs),
pu as (select etype, a, b, ta, tb, unnest(list_distinct(list_concat(ta, tb))) as token from pt),
wj as (select etype, a, b, sum(case when list_contains(ta, token) and list_contains(tb, token) then coalesce(idf, 1.0) else 0 end) / sum(coalesce(idf, 1.0)) as wjaccard from pu left join idf using (etype, token) group by all)"""
WJAC_SQL = WJAC_SQL.replace("group by all", "group by etype, a, b")


@query("q27_weighted_jaccard", f"with {PAIR_SQL}, {IDF_SQL}, {WJAC_SQL} select etype, a, b, round(wjaccard, 6) as wjaccard from wj")
def q27(spark, sf):
    return pair_scores(spark, sf, {"wjaccard": P.weighted}, weigh=True).withColumn("wjaccard", F.round("wjaccard", 6))


@query("q28_structural", f"with {PART_SQL}, t as (select label, min(uri) as uri from p where side = 1 group by label) select s.uri as source, t.uri as target, round(0.1 * {JAC('list_distinct([s.etype, s.p_type])', 'list_distinct([q.etype, q.p_type])')}, 6) as structural from p s join t using (label) join p q on q.uri = t.uri where s.side = 0")
def q28(spark, sf):
    s, t = part_entities(spark, sf)
    least = t.groupBy("label").agg(F.min(F.struct("uri", "parents")).alias("t"))
    return s.join(least, "label").select(F.col("uri").alias("source"), F.col("t.uri").alias("target"), F.round(S.structural_similarity(F.col("parents"), F.col("t.parents")), 6).alias("structural"))


ACRONYM_SQL = f"""ao as (select distinct a, b, lower(case when length(a) <= length(b) then a else b end) as s, lower(case when length(a) <= length(b) then b else a end) as l from pairs),
ai as (select *, replace(s, ' ', '') as sh, list_filter(string_split(l, ' '), lambda w: w <> '') as every, list_filter(string_split(l, ' '), lambda w: w <> '' and not list_contains({STOP_SQL}, w)) as telling from ao),
aj as (select *, array_to_string(list_transform(case when len(telling) >= 2 then telling else every end, lambda w: substr(w, 1, 1)), '') as ini from ai),
acronym as (select a, b, case when length(sh) not between 2 and 8 or not contains(l, ' ') then 0.0 when sh = ini then 1.0 when length(sh) >= 3 and starts_with(ini, sh) then 0.8 else 0.0 end::double as acronym from aj)"""
KERNELS_SQL = f"{PAIR_SQL}, {isub_sql('pairs')}, {indel_sql('pairs')}, {ACRONYM_SQL}"


@query("q29_combined_score", f"with {KERNELS_SQL} select etype, a, b, round(case when a = b and length(a) > 2 then 1.0 else least(1.0, greatest(0.0, 0.6 * {SEM_SQL} + 0.4 * (0.3 * {NGRAM_SQL} + 0.35 * indel + 0.35 * isub) + 0.1 * acronym)) end, 6) as combined from pairs join isub using (a, b) join indel using (a, b) join acronym using (a, b)")
def q29(spark, sf):
    """Labels have no parents here: the structural part is the acronym's."""
    return pair_scores(spark, sf, {"combined": _plain(P.combined)}).withColumn("combined", F.round("combined", 6))


@query("q30_lexical_gate", f"with {KERNELS_SQL}, {IDF_SQL}, {WJAC_SQL} select pairs.etype, a, b, ((a = b and length(a) > 2) or {SEM_SQL} >= 0.88 or greatest(indel, isub, {TOKSET_SQL}) >= 0.45 or coalesce(wjaccard, 0) >= 0.25 or acronym >= 0.8) as passed from pairs left join wj using (etype, a, b) join isub using (a, b) join indel using (a, b) join acronym using (a, b)")
def q30(spark, sf):
    return pair_scores(spark, sf, {"passed": P.passes}, weigh=True).withColumn("passed", F.col("passed") == 1.0)


SCALE_SQL = """sz as (select count(*) filter (side = 0) as ns, count(*) filter (side = 1) as nt from e), s2 as (select case when ns > 100 and nt > 100 then (ns + nt) / 2.0 else (ns + nt) / 4.0 end as size, ns + nt as total from sz),
sc as (select size, total, (case when size < 1000 then 0.95 when size < 12500 then 1.0 when size < 50000 then 1.05 when size < 130000 then 1.08 else 1.18 end) * (case when total < 3000 then 1.05 else 1.0 end) as scale from s2)"""


@query("q31_threshold_filter", f"with {PAIR_SQL}, {SCALE_SQL} select etype, a, b, round({SEM_SQL}, 6) as sem from pairs, sc where {SEM_SQL} >= 0.8 * (scale * 0.92)")
def q31(spark, sf):
    s, t = sides(doc_entities(spark, sf))
    n, m = s.count(), t.count()
    scale = domain.threshold_scale(domain.ontology_size(n, m), n + m, False)
    need = domain.threshold_of(F.col("etype"), Settings()) * (scale * 0.92)
    return pair_scores(spark, sf, {"sem": _plain(P.token_cosine)}).where(F.col("sem") >= need).withColumn("sem", F.round("sem", 6))


BR = lambda x: f"round_even({x}, 0)"


@query("q32_adaptive_k", f"""with {ENT_SQL}, {SCALE_SQL}, b as (select etype, count(*) filter (side = 0) as n_src, count(*) filter (side = 1) as n_tgt from e group by etype having n_src > 0 and n_tgt > 0),
k1 as (select etype, n_src, n_tgt, (case when size < 10000 then 1 when size < 50000 then 2 when size < 130000 then 3 when size < 400000 then 5 else 25 end) as wide, greatest(3, least(50, {BR("2.0 * sqrt(greatest(n_src, n_tgt)::double)")})) as loc from b, sc),
k2 as (select *, {BR("(0.35 * wide + 0.65 * loc)::double")} as base from k1)
select etype, n_src, n_tgt, least(greatest(1, least(150, base)), n_tgt)::bigint as k, least(greatest(1, least(150, floor(base * 1.3))), n_tgt)::bigint as k_relaxed from k2""")
def q32(spark, sf):
    s, t = sides(doc_entities(spark, sf))
    size = domain.ontology_size(s.count(), t.count())
    k = lambda relax: domain.adaptive_k(size, F.col("n_src"), F.col("n_tgt"), F.lit(0.0), relax).cast("long")
    return A.bucket_sizes(s, t).select("etype", "n_src", "n_tgt", k(1.0).alias("k"), k(0.92).alias("k_relaxed"))


@query("q33_ambiguity", f"""with {VEC_SQL}, t as (select * from v where side = 1), picked as (select * from (select *, row_number() over (partition by etype order by md5(uri), uri) as r from t) where r <= 64),
p as (select s.etype, s.uri as source, {DOT} as score, t.uri as target from picked s join t using (etype)), r as (select *, row_number() over (partition by etype, source order by score desc, target) as rank from p),
g as (select etype, source, max(score) - min(score) as gap from r where rank <= 5 group by all)
select etype, round(case when count(*) < 8 then 0.0 else 1.0 - least(1.0, avg(greatest(0.0, least(2.0, gap))) / 0.5) end, 4) as ambiguity from g group by etype""")
def q33(spark, sf):
    return domain.ambiguity(vec_entities(spark, sf)[1]).withColumn("ambiguity", F.round("ambiguity", 4))


@query("q34_greedy_one_to_one", f"""with recursive {knn_sql(3)}, o as (select *, row_number() over (order by score desc, source, target) as n from fwd),
g(n, ss, ts) as (select 0::bigint, []::varchar[], []::varchar[] union all
 select o.n, case when list_contains(ss, source) or list_contains(ts, target) then ss else list_append(ss, source) end, case when list_contains(ss, source) or list_contains(ts, target) then ts else list_append(ts, target) end from g join o on o.n = g.n + 1),
last as (select * from g order by n desc limit 1), z as (select unnest(ss) as source, unnest(ts) as target from last)
select source, target, etype, round(score, 4) as score from z join fwd using (source, target)""")
def q34(spark, sf):
    fwd = knn.nearest(*vec_entities(spark, sf), 3).select("source", "target", "etype", "score")
    return resolve.greedy_one_to_one(fwd).withColumn("score", F.round("score", 4))


@query("q35_two_stage_align")
def q35(spark, sf):
    return A.align(*sides(doc_entities(spark, sf)), Settings(medical=False))


# Each source has one candidate, so the walk by score gives each target to its best source.
V1_SQL = f"""last as (select label, max(uri) as target, arg_max(etype, uri) as etype from e where side = 1 group by label),
lock as (select uri as source, target, e.etype from e join last on e.label = last.label and e.etype = last.etype where side = 0),
s as (select * from e where side = 0 and uri not in (select source from lock)), t as (select * from e where side = 1 and uri not in (select target from lock)),
p as (select s.etype, s.uri as source, t.uri as target, s.label as a, t.label as b, {SEM_SQL.replace("string_split(a,", "string_split(s.label,").replace("string_split(b,", "string_split(t.label,")} as score from s join t on s.etype = t.etype),
best as (select * from (select *, row_number() over (partition by source order by score desc, target) as n from p where score >= 0.78) where n = 1),
kept as (select * from best where score >= 0.8 and abs(length(a) - length(b)) <= 0.6 * greatest(length(a), length(b))),
won as (select * from (select *, row_number() over (partition by target order by score desc, source) as w from kept) where w = 1)"""


@query("q36_align_v1", f"with {ENT_SQL}, {V1_SQL} select source, target, etype, 1.0::double as score from lock union all select source, target, etype, round(score, 6) from won")
def q36(spark, sf):
    return A.align_v1(*sides(doc_entities(spark, sf))).withColumn("score", F.round("score", 6))


@query("q37_predicate_projection", f"with {TYPED_SQL}, n as (select subject as uri, {NAME_SQL} as etype from ty) select uri, case when contains(etype, 'Class') then '{OWL}equivalentClass' when contains(etype, 'Property') then '{OWL}equivalentProperty' else '{OWL}sameAs' end as predicate, case when contains(etype, 'Concept') then '{SKOS}exactMatch' when contains(etype, 'Class') then '{OWL}equivalentClass' when contains(etype, 'Property') then '{OWL}equivalentProperty' else '{OWL}sameAs' end as predicate_v1 from n")
def q37(spark, sf):
    found = entities.subjects(entities.relevant(triples(spark, sf)))
    return found.select("uri", L.predicate_of(F.col("etype")).alias("predicate"), L.predicate_of(F.col("etype"), SKOS + "exactMatch").alias("predicate_v1"))


# --- gold, metrics and sinks -------------------------------------------------------------------------------


GOLD_LINES = "select case when n_nationkey % 4 = 0 then ' x' || n_nationkey || ' ' else 'x' || n_nationkey end as s, case when n_nationkey % 5 = 0 then '' else 'a' || (24 - n_nationkey) end as t, case n_nationkey % 3 when 0 then '=' when 1 then 'EquivalentProperty' else 'sameAs' end as r from nation"


@query("q38_gold_tsv_canonical", f"with g as ({GOLD_LINES}), c as (select trim(s) as s, trim(t) as t, r from g) select distinct least(s, t) as source, case lower(r) when 'equivalentproperty' then '{OWL}equivalentProperty' when 'sameas' then '{OWL}sameAs' else '{OWL}equivalentClass' end as predicate, greatest(s, t) as target from c where s <> '' and t <> ''")
def q38(spark, sf):
    nation = table(spark, sf, "nation")
    nation.createOrReplaceTempView("_ontoloom_nation")
    lines = spark.sql(GOLD_LINES.replace("from nation", "from _ontoloom_nation")).select(F.array("s", "t", "r").alias("cells"))
    return gold.canonical(gold.from_cells(lines, ["SrcEntity", "TgtEntity", "Relation"]))


NT = "select '<http://a/' || s_suppkey || '> <http://p/' || (s_suppkey % 3) || '> ' || case when s_suppkey % 4 = 0 then '\"literal\"' else '<http://b/' || s_nationkey || '>' end || ' .' as line from {} union all select '# comment'"


@query("q39_gold_ntriples_regex", f"with l as ({NT.format('supplier')}), m as (select regexp_extract(line, '^<([^>]+)>\\s+<([^>]+)>\\s+<([^>]+)>\\s*\\.\\s*$', ['s', 'p', 'o']) as m from l) select distinct least(m.s, m.o) as source, m.p as predicate, greatest(m.s, m.o) as target from m where m.s <> ''")
def q39(spark, sf):
    table(spark, sf, "supplier").createOrReplaceTempView("_ontoloom_supplier")
    return gold.canonical(gold.from_ntriples(spark.sql(NT.format("_ontoloom_supplier"))))


@query("q40_gold_predicates_v1", f"with {TRIPLES_SQL} select distinct least(subject, object) as source, predicate, greatest(subject, object) as target from triples where predicate in ('{RDFS}subClassOf')")
def q40(spark, sf):
    return gold.canonical(gold.from_triples_v1(triples(spark, sf)))


SYS_SQL = f"{ENT_SQL}, {LOCK_SQL}, sys as (select source, target from lock), gold as (select case when source::bigint % 3 = 0 then target else source end as source, case when source::bigint % 3 = 0 then source else target end as target from lock where source::bigint % 5 <> 0 union all select 'g' || n_nationkey, 'h' || n_nationkey from nation)"
P4 = "round({0}, 4)"


def _system_and_gold(spark, sf):
    lock = resolve.exact_locks(*sides(doc_entities(spark, sf))).select("source", "target")
    i = F.col("source").cast("long")
    part = lock.where(i % 5 != 0).select(F.when(i % 3 == 0, F.col("target")).otherwise(F.col("source")).alias("source"), F.when(i % 3 == 0, F.col("source")).otherwise(F.col("target")).alias("target"))
    more = table(spark, sf, "nation").select(F.concat(F.lit("g"), F.col("n_nationkey")).alias("source"), F.concat(F.lit("h"), F.col("n_nationkey")).alias("target"))
    return lock, part.unionByName(more)


def _prf_sql(head: str) -> str:
    return f"""with {head}, r as (select case when n_system > 0 then tp::double / n_system else 0.0 end as p, case when n_gold > 0 then tp::double / n_gold else 0.0 end as r, * from c)
select round(p, 4) as precision, round(r, 4) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end, 4) as f1, tp, n_system, n_gold from r"""


@query("q41_prf_undirected", _prf_sql(SYS_SQL + ", s as (select distinct least(source, target) as a, greatest(source, target) as b from sys), g as (select distinct least(source, target) as a, greatest(source, target) as b from gold), c as (select (select count(*) from s join g using (a, b)) as tp, (select count(*) from s) as n_system, (select count(*) from g) as n_gold)"))
def q41(spark, sf):
    return evaluate.prf(*_system_and_gold(spark, sf))


@query("q42_prf_typed_v1", _prf_sql(SYS_SQL + ", s as (select distinct least(source, target) as a, 'p' as q, greatest(source, target) as b from sys), g as (select distinct least(source, target) as a, case when length(source) % 2 = 0 then 'p' else 'q' end as q, greatest(source, target) as b from gold), c as (select (select count(*) from s join g using (a, q, b)) as tp, (select count(*) from s) as n_system, (select count(*) from g) as n_gold)"))
def q42(spark, sf):
    s, g = _system_and_gold(spark, sf)
    return evaluate.prf_typed(s.withColumn("predicate", F.lit("p")), g.withColumn("predicate", F.when(F.length("source") % 2 == 0, "p").otherwise("q")))


def _partial_sql(column: str) -> str:
    return f"""with {SYS_SQL}, g as (select distinct source, target from gold), k as (select *, source in (select source from g) or target in (select {column} from g) as known, (source, target) in (select (source, target) from g) as hit from (select distinct source, target from sys)),
c as (select count(*) filter (known and hit) as tp, count(*) filter (known and not hit) as fp, count(*) filter (not known) as ig, count(*) as n, (select count(*) from g) as m from k),
r as (select *, m - tp as fn, case when tp + fp > 0 then tp::double / (tp + fp) else 0.0 end as p, case when m > 0 then tp::double / m else 0.0 end as r from c)
select p as precision, r as recall, case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end as f1, tp as true_positives, fp as false_positives, fn as false_negatives, ig as ignored, n as system_size, n - ig as evaluated_size, m as reference_size, 'kg_partial' as source from r"""


@query("q43_prf_partial_gold", _partial_sql("source"))
def q43(spark, sf):
    return evaluate.prf_partial(*_system_and_gold(spark, sf))


@query("q43b_prf_partial_gold_targets", _partial_sql("target"))
def q43b(spark, sf):
    return evaluate.prf_partial(*_system_and_gold(spark, sf), compat=False)


REPORT = "select r_name as track, n_name as task, round((n_nationkey % 7) / 7.0, 4)::double as precision, round((n_nationkey % 5) / 5.0, 4)::double as recall, round((n_nationkey % 3) / 3.0, 4)::double as f1, (n_nationkey * 1.5)::double as seconds from {0}nation join {0}region on n_regionkey = r_regionkey"


@query("q44_track_averages", f"with r as ({REPORT.format('')}) select track, task, precision, recall, f1, seconds, 'Task' as type from r union all select track, 'AVERAGE', round(avg(precision), 4), round(avg(recall), 4), round(avg(f1), 4), round(avg(seconds), 2), 'Average' from r group by track union all select 'ALL', 'TOTAL', null, null, null, round(sum(seconds), 2), 'Summary' from r")
def q44(spark, sf):
    for name in ("nation", "region"):
        table(spark, sf, name).createOrReplaceTempView(f"_ontoloom_{name}")
    return evaluate.track_averages(spark.sql(REPORT.format("_ontoloom_")))


def _written_alignment(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.concat(F.lit("http://s/"), F.col("p_partkey").cast("string"), F.lit("?a=<1>&b=\"2\"")).alias("source"), F.concat(F.lit("http://t/"), F.col("p_size").cast("string")).alias("target"), F.lit(OWL + "Class").alias("etype"), (F.col("p_size") / 100.0).alias("score"))


AL_SQL = "al as (select 'http://s/' || p_partkey || '?a=<1>&b=\"2\"' as source, 'http://t/' || p_size as target, p_size / 100.0 as score from part)"
ESC = lambda x: f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query("q45_tsv_lines", f"with {AL_SQL} select source || chr(9) || target || chr(9) || '=' || chr(9) || printf('%.4f', score::double) as line from al")
def q45(spark, sf):
    return sinks.tsv_lines(_written_alignment(spark, sf))


@query("q46_cell_xml_lines", f"""with {AL_SQL}, n as (select *, row_number() over (order by source, target) - 1 as i from al) select '  <align:map>' || chr(10) || '    <align:Cell rdf:about="#cell' || i || '">' || chr(10) || '      <align:entity1 rdf:resource="' || {ESC("source")} || '"/>' || chr(10) || '      <align:entity2 rdf:resource="' || {ESC("target")} || '"/>' || chr(10) || '      <align:relation>=</align:relation>' || chr(10) || '      <align:measure rdf:datatype="http://www.w3.org/2001/XMLSchema#float">' || printf('%.4f', score::double) || '</align:measure>' || chr(10) || '    </align:Cell>' || chr(10) || '  </align:map>' as cell from n""")
def q46(spark, sf):
    return sinks.cells(_written_alignment(spark, sf)).select("cell")


@query("q47_ttl_lines", f"with {AL_SQL} select '<' || replace(replace(replace(source, '<', '%3C'), '>', '%3E'), '\"', '%22') || '> owl:equivalentClass <' || target || '> .' as line from al")
def q47(spark, sf):
    return sinks.turtle_lines(_written_alignment(spark, sf)).select("line")


MED = "[" + ",".join(f"'{w}'" for w in domain.MEDICAL_WORDS) + "]"


@query("q48_medical_detector", f"""with {ENT_SQL}, u as (select uri from e order by side, uri limit 1000), l as ((select label from e where side = 0 order by uri limit 500) union all (select label from e where side = 1 order by uri limit 500)),
t as (select sum(len(list_intersect({WORDS("lower(label)")}, {MED}))) as m, sum(len({WORDS("lower(label)")})) as n from l)
select coalesce((select avg(regexp_matches(uri, 'purl\\.obolibrary\\.org/obo/(DOID|HP|MP|MONDO|CHEBI|NCIT|UBERON|CL|GO|PR|SYMP|VO|MA|FMA)_|snomed\\.info/id/|nlm\\.nih\\.gov/mesh/|bioportal\\.bioontology\\.org/ontologies/|identifiers\\.org/(doid|hp|chebi|mesh|ncit)', 'i')::int::double) from u), 0.0) as uri_ratio, case when n > 0 then m::double / n else 0.0 end as token_ratio from t""")
def q48(spark, sf):
    return domain.medical_ratios(*sides(doc_entities(spark, sf)))


RANK_V1_SQL = f"case when lang in ('en','de','fr') and predicate in ('{SKOS}prefLabel', '{RDFS}label') then (case lang when 'en' then 0 when 'de' then 2 else 4 end) + (case predicate when '{SKOS}prefLabel' then 0 else 1 end) when predicate = '{RDFS}label' then 6 when predicate = '{SKOS}prefLabel' then 7 end"
LABEL_V1_SQL = r"array_to_string(list_filter(regexp_split_to_array(lower(translate(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '_-', '  ')), '\s+'), lambda w: w <> '')[1:15], ' ')"
ENTITIES_V1_SQL = f"""{TRIPLES_SQL}, ty as (select subject, min(case when predicate <> '{RDF}type' then null when object = '{SKOS}Concept' then 0 when object = '{OWL}Class' then 1 when object in ('{OWL}ObjectProperty', '{OWL}DatatypeProperty') then 2 end) as k from triples group by subject),
lb as (select subject, object as text, row_number() over (partition by subject order by {RANK_V1_SQL}, object) as rn from triples where ({RANK_V1_SQL}) is not null),
x as (select ty.subject as uri, {LABEL_V1_SQL.format("coalesce(lb.text, regexp_extract(ty.subject, '[^/#]*$'))")} as label, {NAME_SQL} as etype from ty left join lb on lb.subject = ty.subject and rn = 1 where not starts_with(ty.subject, '{OWL}'))"""
GROUP_SQL = f"case etype when '{OWL}Class' then 0 when '{SKOS}Concept' then 1 when '{OWL}ObjectProperty' then 2 else 3 end"


@query("q49_entity_limit", f"with {ENTITIES_V1_SQL} select * from x where label <> '' order by {GROUP_SQL}, uri limit 300")
def q49(spark, sf):
    return entities.entities_v1(triples(spark, sf), 300).drop("parents")


@query("q49b_entities_v1", f"with {ENTITIES_V1_SQL} select * from x where label <> ''")
def q49b(spark, sf):
    return entities.entities_v1(triples(spark, sf)).drop("parents")


CELLS_SQL = "c as (select 'c' || n_nationkey as subject, 'e1' as predicate, n_name as object from nation where n_nationkey % 2 = 0 union all select 'c' || n_nationkey, 'e2', n_name || 'x' from nation where n_nationkey % 3 = 0)"


@query("q50_cell_intersection", f"with {CELLS_SQL} select a.object as source, b.object as target from c a join c b using (subject) where a.predicate = 'e1' and b.predicate = 'e2'")
def q50(spark, sf):
    n = table(spark, sf, "nation")
    c = lambda every, p, o: n.where(F.col("n_nationkey") % every == 0).select(F.concat(F.lit("c"), F.col("n_nationkey")).alias("subject"), F.lit(gold.CELL + p).alias("predicate"), o.alias("object"), F.lit("iri").alias("o_kind"))
    return gold.from_cell_triples(c(2, "entity1", F.col("n_name")).unionByName(c(3, "entity2", F.concat("n_name", F.lit("x"))))).select("source", "target")


@query("q51_l2_normalise", "select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double))))), 6) as total, len(embedding)::bigint as n from embeddings")
def q51(spark, sf):
    unit = V.l2_normalised(F.col("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(unit, F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.size("embedding").cast("long").alias("n"))


@query("q52_embedding_cache_split", f"with {ENT_SQL}, k as (select distinct label from e where side = 0) select distinct label, label in (select label from k) as cached from e")
def q52(spark, sf):
    e = doc_entities(spark, sf)
    hit, miss = embed.split_by_cache(e.select("label"), e.where("side = 0").select("label").distinct().withColumn("vec", F.array(F.lit(1.0))))
    return hit.select("label", F.lit(True).alias("cached")).unionByName(miss.select("label", F.lit(False).alias("cached")))


RECALL_SQL = "select distinct s.label::varchar as etype, true as enough from embeddings s join embeddings t on s.label = t.label and s.vec_id % 2 = 0 and t.vec_id % 2 = 1"


def _recall(s, t, found):
    """Whether at least 0.9 of each type's three nearest are found: exact search over all rows."""
    exact = knn.nearest(s, t, 3).select("etype", "source", "target")
    met = exact.join(found.select("source", "target", F.lit(1).alias("hit")), ["source", "target"], "left")
    return met.groupBy("etype").agg((F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("enough"))


@query("q53_ivf_knn", RECALL_SQL)
def q53(spark, sf):
    """Probes are those that a sample of sources asks for; the recall is that of all sources, type by type."""
    s, t = vec_entities(spark, sf)
    cells = knn.centroids(t)
    return _recall(s, t, knn.ivf_nearest(s, t, 3, cells, knn.probes_for(s, t, 3, cells, 0.95)[0]))


@query("q53b_ivfpq_knn", RECALL_SQL)
def q53b(spark, sf):
    s, t = vec_entities(spark, sf)
    cells = knn.centroids(t)
    return _recall(s, t, knn.ivfpq_nearest(s, t, 3, cells, knn.codebooks(t), knn.probes_for(s, t, 3, cells, 0.95)[0], more=16))


@query("q54_entities", f"with {TYPED_SQL}, {LABEL_SQL}, x as (select ty.subject as uri, {norm_sql('lb.text')} as label, {NAME_SQL} as etype from ty join lb on lb.subject = ty.subject and rn = 1 where not starts_with(ty.subject, '{OWL}')) select * from x where label <> ''")
def q54(spark, sf):
    return entities.entities(triples(spark, sf)).drop("parents")


@query("q55_align_vectors")
def q55(spark, sf):
    e = doc_entities(spark, sf)
    return A.align(*sides(e), Settings(medical=False), vectors=embed.encode(e))
