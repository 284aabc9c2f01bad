"""Named queries that write files, read them back and run whole tasks, with the same results in DuckDB SQL.

Files lie in the shared folder; what is written comes from nation, region, supplier and part."""

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.config import CLASS, INDIVIDUAL, OBJECT_PROPERTY, OWL, RDF, RDFS, SKOS, Settings
from ontoloom.functions import labels as L
from ontoloom.functions import similarity as S
from ontoloom.operators import domain, embed, entities
from ontoloom.plans import align as A
from ontoloom.plans import run
from ontoloom.plans.catalogue import NORM, doc_entities, query, sides, table
from ontoloom.shared import new_place, written
from ontoloom.sources import catalog, gold, sinks
from ontoloom.sources.rdf import read_triples

NATIONS = "http://ex.org/nation#"
REGIONS = "http://ex.org/region#"
UNION = " union all "


def folder(spark: SparkSession, name: str) -> Path:
    """A new folder in the shared one, as the driver sees it."""
    place = Path(new_place(spark, name).removeprefix("file://").removeprefix("file:"))
    place.mkdir(parents=True)
    return place


# --- ontologies ---------------------------------------------------------------------------------------------

#: what each syntax says of a nation, and what stands around all of them
SYNTAXES = {
    "turtle": ("@prefix owl: <http://www.w3.org/2002/07/owl#> .\n@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .", '<%s> a owl:Class ; rdfs:label "%s"@en ; rdfs:subClassOf <%s> .', ""),
    "rdfxml": (f'<?xml version="1.0"?>\n<rdf:RDF xmlns:rdf="{RDF}" xmlns:owl="{OWL}" xmlns:rdfs="{RDFS}">', '<owl:Class rdf:about="%s"><rdfs:label xml:lang="en">%s</rdfs:label><rdfs:subClassOf rdf:resource="%s"/></owl:Class>', "</rdf:RDF>"),
    "functional": (f"Prefix(rdfs:=<{RDFS}>)\nOntology(<http://ex.org/>", 'Declaration(Class(<%1$s>)) AnnotationAssertion(rdfs:label <%1$s> "%2$s"@en) SubClassOf(<%1$s> <%3$s>)', ")"),
    "manchester": (f"Prefix: rdfs: <{RDFS}>\nOntology: <http://ex.org/>", 'Class: <%s>\n    Annotations: rdfs:label "%s"@en\n    SubClassOf: <%s>', ""),
}


def written_nations(spark: SparkSession, sf: str, place: Path, syntax: str, name: str) -> str:
    """The nations as classes with a label and their region as parent, in one file of a syntax."""
    head, each, foot = SYNTAXES[syntax]
    uri = lambda prefix, key: F.concat(F.lit(prefix), F.col(key).cast("string"))
    lines = table(spark, sf, "nation").orderBy("n_nationkey").select(F.format_string(each, uri(NATIONS, "n_nationkey"), F.col("n_name"), uri(REGIONS, "n_regionkey")))
    sinks._one_file(lines, str(place / name), head, foot)
    return str(place / name)


NATION_TRIPLES = f"""select '{NATIONS}' || n_nationkey as subject, '{RDF}type' as predicate, '{CLASS}' as object, null::varchar as lang from nation
 union all select '{NATIONS}' || n_nationkey, '{RDFS}label', n_name, 'en' from nation union all select '{NATIONS}' || n_nationkey, '{RDFS}subClassOf', '{REGIONS}' || n_regionkey, null from nation"""


@query("q56_rdf_syntaxes", f"with t as ({NATION_TRIPLES}) select syntax, t.* from t, (values ('turtle'), ('rdfxml'), ('functional'), ('manchester')) s(syntax)")
def q56(spark: SparkSession, sf: str) -> DataFrame:
    """Each syntax by its content, whatever its suffix."""
    place, out = folder(spark, "syntaxes"), None
    for syntax in SYNTAXES:
        read = read_triples(spark, written_nations(spark, sf, place, syntax, f"{syntax}.owl")).select(F.lit(syntax).alias("syntax"), "subject", "predicate", "object", "lang")
        out = read if out is None else out.unionByName(read)
    return out


@query("q57_syntax_by_suffix", f"with t as ({NATION_TRIPLES}) select suffix, t.* from t, (values ('ttl'), ('owl')) s(suffix)")
def q57(spark: SparkSession, sf: str) -> DataFrame:
    """The suffix says what is tried first; a file that is something else is read as that."""
    place, out = folder(spark, "suffixes"), None
    for suffix in ("ttl", "owl"):
        read = read_triples(spark, written_nations(spark, sf, place, "turtle", f"n.{suffix}"), syntaxBy="suffix").select(F.lit(suffix).alias("suffix"), "subject", "predicate", "object", "lang")
        out = read if out is None else out.unionByName(read)
    return out


NATION_NAME = NORM.replace("coalesce(text, '')", "n_name")


@query("q58_entities_of_files", f"with n as (select *, {NATION_NAME} as label from nation) select syntax, '{NATIONS}' || n_nationkey as uri, label, '{CLASS}' as etype, '{REGIONS}' || n_regionkey as parents from n, (values ('rdfxml'), ('functional')) s(syntax)")
def q58(spark: SparkSession, sf: str) -> DataFrame:
    place, out = folder(spark, "entities"), None
    for syntax in ("rdfxml", "functional"):
        found = run.load_entities(spark, written_nations(spark, sf, place, syntax, f"{syntax}.owl")).select(F.lit(syntax).alias("syntax"), "uri", "label", "etype", F.array_join("parents", ",").alias("parents"))
        out = found if out is None else out.unionByName(found)
    return out


@query("q59_lenient_entities", f"with n as (select *, {NATION_NAME} as label from nation) select case when n_nationkey % 2 = 0 then '_:b' else '{NATIONS}' end || n_nationkey as uri, label, '{CLASS}' as etype from n union all select '{NATIONS}x' || n_nationkey, label, '{INDIVIDUAL}' from n")
def q59(spark: SparkSession, sf: str) -> DataFrame:
    """Without strictness blank subjects are entities, and labels may be IRIs."""
    n = table(spark, sf, "nation")
    even = F.col("n_nationkey") % 2 == 0
    subject = F.concat(F.when(even, "_:b").otherwise(NATIONS), F.col("n_nationkey").cast("string"))
    t = lambda s, iri, p, o, kind: n.select(s.alias("subject"), iri.alias("s_is_iri"), F.lit(p).alias("predicate"), o.alias("object"), F.lit(kind).alias("o_kind"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("datatype"))
    rows = t(subject, ~even, RDF + "type", F.lit(CLASS), "iri").unionByName(t(subject, ~even, RDFS + "label", F.col("n_name"), "literal"))
    rows = rows.unionByName(t(F.concat(F.lit(NATIONS + "x"), F.col("n_nationkey").cast("string")), F.lit(True), RDFS + "label", F.col("n_name"), "iri"))
    return entities.entities(rows, strict=False).select("uri", "label", "etype")


@query("q60_parents_of_large_ontologies", f"select size, '{NATIONS}' || n_nationkey as uri, size < 130000 as kept from nation, (values (129999), (130000)) s(size)")
def q60(spark: SparkSession, sf: str) -> DataFrame:
    found = run.load_entities(spark, written_nations(spark, sf, folder(spark, "parents"), "turtle", "n.ttl"))
    cut = lambda size: entities.without_parents(found, size, Settings().parents_below).select(F.lit(size).alias("size"), "uri", F.coalesce(F.size("parents") > 0, F.lit(False)).alias("kept"))
    return cut(129_999).unionByName(cut(130_000))


# --- gold and reports ------------------------------------------------------------------------------------------

PAIRS = "select 'http://b/' || s_suppkey as source, 'http://a/' || s_nationkey as target from supplier"
CANONICAL = f"select distinct target as source, '{OWL}equivalentClass' as predicate, source as target from p"


def supplier_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(F.concat(F.lit("http://b/"), F.col("s_suppkey").cast("string")).alias("source"), F.concat(F.lit("http://a/"), F.col("s_nationkey").cast("string")).alias("target"), F.lit(CLASS).alias("etype"), F.lit(0.5).alias("score"))


def written_pairs(spark: SparkSession, sf: str) -> dict[str, str]:
    """The pairs as an alignment table, statements a line, alignment cells and plain Turtle."""
    place, pairs = folder(spark, "gold"), supplier_pairs(spark, sf)
    sinks.write_tsv(pairs, str(place / "g.tsv"))
    sinks.write_cells(pairs, str(place / "g.rdf"))
    sinks.write_turtle(pairs, str(place / "g.ttl"))
    sinks._one_file(pairs.select(F.format_string(f"<%s> <{OWL}equivalentClass> <%s> .", "source", "target")), str(place / "g.nt"), "# comment")
    return {p.name: str(p) for p in place.iterdir()}


@query("q61_gold_by_format", f"with p as ({PAIRS}), c as ({CANONICAL}) select name, c.* from c, (values ('g.tsv'), ('g.rdf'), ('g.ttl'), ('g.nt')) s(name)")
def q61(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for name, path in written_pairs(spark, sf).items():
        found = gold.read_gold(spark, path).select(F.lit(name).alias("name"), "source", "predicate", "target")
        out = found if out is None else out.unionByName(found)
    return out


@query("q62_directed_pairs_by_format", f"with p as (select distinct * from ({PAIRS})) select name, p.* from p, (values ('g.tsv'), ('g.rdf'), ('g.ttl')) s(name)")
def q62(spark: SparkSession, sf: str) -> DataFrame:
    """Tables, cells, and statements that are not owl:sameAs, all as directed pairs."""
    out, paths = None, written_pairs(spark, sf)
    for name in ("g.tsv", "g.rdf", "g.ttl"):
        found = gold.read_directed(spark, paths[name]).select(F.lit(name).alias("name"), "source", "target")
        out = found if out is None else out.unionByName(found)
    return out


REPORT_SQL = "select r_name as track, n_name as task, cast(cast(n_nationkey / 25.0 as decimal(6, 4)) as {1}) as precision, 'N/A' as recall, 'say \"x, y\"' as f1_score, cast(n_nationkey as {1}) as time_s, 'Task' as type from {0}nation join {0}region on n_regionkey = r_regionkey"
PLAIN = {c: c.lower().replace("(", "").replace(")", "").replace(" ", "_").replace("-", "_") for c in sinks.REPORT}


def plain(report: DataFrame) -> DataFrame:
    """A report under names that need no quotes."""
    return report.select(*[F.col(f"`{c}`").alias(PLAIN[c]) for c in report.columns])


@query("q63_reports", f"with r as ({REPORT_SQL.format('', 'varchar')}) select 'v2' as version, *, '0' as alignments from r union all select 'v1', *, null from r")
def q63(spark: SparkSession, sf: str) -> DataFrame:
    """A report of 11 columns with a header and one of 7 without, written and read as CSV."""
    for name in ("nation", "region"):
        table(spark, sf, name).createOrReplaceTempView(f"_ontoloom_{name}")
    rows = spark.sql(REPORT_SQL.format("_ontoloom_", "string")).toDF(*sinks.REPORT_V1)
    place = folder(spark, "reports")
    full = rows.withColumns({c: F.lit("0") for c in ("Total Time (s)", "Alignments", "Correct", "Reference")})
    sinks.write_report(full, str(place / "v2.csv"))
    sinks.write_report(rows, str(place / "v1.csv"), v1=True)
    read = spark.read.option("escape", '"')
    new = plain(read.option("header", True).csv(str(place / "v2.csv")))
    old = plain(read.option("header", False).csv(str(place / "v1.csv")).toDF(*sinks.REPORT_V1))
    names = [PLAIN[c] for c in sinks.REPORT_V1]
    return new.select(F.lit("v2").alias("version"), *names, "alignments").unionByName(old.select(F.lit("v1").alias("version"), *names, F.lit(None).cast("string").alias("alignments")))


# --- folders of tracks -------------------------------------------------------------------------------------------

TREE = [
    "a/ontologies/x.owl", "a/ontologies/y.ttl", "a/x-y.ttl", "a/x-y-z.ttl", "b/m.rdf", "b/n.xml", "b/m-n.rdf", "bio/ncit.owl", "bio/doid.ttl", "bio/refs_equiv/full.tsv",
    "pair/one.owl", "pair/two.rdf", "pair/references/two-one.csv", "none/only.owl", "kg/starwars-swg/refs/onto1-onto2.rdf", "kg/reference/swtor-starwars.xml",
]
TASKS = [("a", "x-y", "x.owl", "y.ttl", "a/x-y.ttl"), ("b", "m-n", "m.rdf", "n.xml", "b/m-n.rdf"), ("bio", "ncit-doid", "ncit.owl", "doid.ttl", "bio/refs_equiv/full.tsv"), ("pair", "one-two", "one.owl", "two.rdf", "pair/references/two-one.csv")]
KG_FOUND = [("starwars-swg", "kg/starwars-swg/refs/onto1-onto2.rdf"), ("starwars-swtor", "kg/reference/swtor-starwars.xml"), ("memoryalpha-memorybeta", None)]
FOUND_SQL = " union all ".join([*(f"select 'v2' as way, '{a}' as track, '{b}' as name, '{c}' as source, '{d}' as target, '{e}' as reference" for a, b, c, d, e in TASKS), "select 'v1', 'a', 'x-y', 'x.owl', 'y.ttl', 'a/x-y.ttl'", *(f"select 'kg', 'kg', '{a}', null, null, " + (f"'{b}'" if b else "null") for a, b in KG_FOUND)])


@query("q64_tasks_of_folders", FOUND_SQL)
def q64(spark: SparkSession, sf: str) -> DataFrame:
    base = folder(spark, "tracks")
    for name in TREE:
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_text("")
    below = lambda p: None if p is None else str(p.relative_to(base))
    rows = [(way, t.track, t.name, t.source.name, t.target.name, below(t.reference)) for way in ("v2", "v1") for t in catalog.tasks(base, way == "v1")]
    rows += [("kg", "kg", stem, None, None, below(catalog.find_kg_reference(base / "kg", stem))) for stem, _ in KG_FOUND]
    return spark.createDataFrame(rows, "way string, track string, name string, source string, target string, reference string")


PAIR_LABELS = f"with n as (select *, {NATION_NAME} as label from nation), one as (select label from n group by label having count(*) = 1 and min(length(label)) > 2), m as (select count(*) as n from one), t as (select count(*) as n from nation)"


@query("q65_benchmark_run", f"{PAIR_LABELS} select 'track' as track, 'one-two' as task, '1.0' as precision, round(m.n / t.n, 4)::varchar as recall, m.n::varchar as alignments, m.n::varchar as correct, t.n::varchar as reference, 'Task' as type from m, t")
def q65(spark: SparkSession, sf: str) -> DataFrame:
    """Two ontologies of the same classes under other names, their gold, and a run from folder to report."""
    base = folder(spark, "run")
    track = base / "tracks" / "track"
    (track / "ontologies").mkdir(parents=True)
    written_nations(spark, sf, track / "ontologies", "turtle", "one.ttl")
    text = Path(written_nations(spark, sf, track / "ontologies", "rdfxml", "two.owl"))
    text.write_text(text.read_text().replace(NATIONS, "http://other.org/n#"))
    n = table(spark, sf, "nation").select(F.concat(F.lit(NATIONS), F.col("n_nationkey").cast("string")).alias("source"), F.concat(F.lit("http://other.org/n#"), F.col("n_nationkey").cast("string")).alias("target"), F.lit(CLASS).alias("etype"))
    sinks.write_turtle(n, str(track / "one-two.ttl"))
    run.run_all(spark, str(base / "tracks"), str(base / "out"), Settings(medical=False), encoder=None)
    report = plain(spark.read.option("header", True).csv(str(base / "out" / "report.csv")))
    return report.select("track", "task", "precision", "recall", "alignments", "correct", "reference", "type")


KG_SQL = f"""with p as (select distinct * from ({PAIRS})), g as (select * from p where target <> 'http://a/3'), k as (select p.*, p.source in (select source from g) or p.target in (select source from g) as known, exists (select 1 from g where g.source = p.source and g.target = p.target) as hit from p),
c as (select count(*) as n, count(*) filter (known and hit) as tp, count(*) filter (known and not hit) as fp, (select count(*) from g) as m from k)
select 'starwars-swg' as task, printf('%.1f', case when tp + fp > 0 then tp / (tp + fp) else 0.0 end::double) as precision, printf('%.1f', case when m > 0 then tp / m else 0.0 end::double) as recall, n::varchar as alignments, tp::varchar as correct, m::varchar as reference, 'N/A' as time_s from c"""


@query("q66_knowledge_graph_run", KG_SQL)
def q66(spark: SparkSession, sf: str) -> DataFrame:
    """A system's cells and partial gold, from files to the report's file."""
    base, pairs = folder(spark, "kg"), supplier_pairs(spark, sf)
    (base / "track" / "refs").mkdir(parents=True)
    sinks.write_cells(pairs, str(base / "starwars-swg.rdf"))
    sinks.write_tsv(pairs.where("target <> 'http://a/3'"), str(base / "track" / "refs" / "starwars-swg.tsv"))
    run.evaluate_knowledge_graphs(spark, str(base), str(base / "track"), report=str(base / "kg.csv"))
    return plain(spark.read.option("header", True).csv(str(base / "kg.csv"))).select("task", "precision", "recall", "alignments", "correct", "reference", "time_s")


# --- encoders, caches and functions ---------------------------------------------------------------------------------

E_SQL = f"e as (select * from (select {NORM} as label, doc_id % 2 as side from documents) where label <> '')"


@query("q67_embedding_cache", f"with {E_SQL}, k as (select distinct label from e where side = 0) select distinct e.label, 256::bigint as n, 1.0::double as length, k.label is not null as from_cache from e left join k on e.label = k.label")
def q67(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of one side are encoded and kept; for both sides only the others are encoded."""
    e, path = doc_entities(spark, sf), new_place(spark, "cache")
    embed.encode_cached(e.where("side = 0"), path)
    known = written(embed.read_cache(spark, path, "hashed_trigrams").select("label", F.lit(True).alias("from_cache")), "known")
    both = embed.encode_cached(e, path).join(known, "label", "left")
    return both.select("label", F.size("vec").cast("long").alias("n"), F.round(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), 4).alias("length"), F.coalesce("from_cache", F.lit(False)).alias("from_cache"))


@query("q68_vectors_as_they_are", f"with {E_SQL} select distinct label, (length(label) + 1)::double as at_most, true as fits from e")
def q68(spark: SparkSession, sf: str) -> DataFrame:
    """Without normalisation a vector is the sum of its trigrams' signs: no longer than their number."""
    found = embed.encode(doc_entities(spark, sf), normalise=False)
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + F.abs(x.cast("double")))
    n = (F.length("label") + 1).cast("double")
    return found.select("label", n.alias("at_most"), ((total <= n) & ((n - total) % 2 == 0)).alias("fits"))


SIZES = [1, 2999, 3000, 500_000]


@query("q69_encoders", UNION.join(f"select {n} as total, {m} as medical, {label} as name, {longest} as longest" for n in SIZES for m in ("false", "true") for label, longest in [("'BAAI/bge-m3'", 64) if n < 3000 else ("'cambridgeltl/SapBERT-from-PubMedBERT-fulltext'", 128) if m == "true" else ("'sentence-transformers/all-MiniLM-L12-v2'", 128)]))
def q69(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(n, medical, *run.encoder_for(n, medical, load=lambda name, longest: (name, longest))[1]) for n in SIZES for medical in (False, True)]
    return spark.createDataFrame(rows, "total int, medical boolean, name string, longest int")


ASCII = "regexp_replace(strip_accents({0}), '[^\\x00-\\x7F]', '', 'g')"


@query("q70_sql_functions", f"select n_nationkey, {ASCII.format('n_name')} as folded, 1.0::double as same, case when contains(n_name, ' ') then 1.0::double else 0.0 end as indel_is_less from nation")
def q70(spark: SparkSession, sf: str) -> DataFrame:
    """The kernels by their names in SQL."""
    S.register(spark)
    table(spark, sf, "nation").createOrReplaceTempView("_ontoloom_nation")
    return spark.sql("select n_nationkey, ascii_folded(n_name) as folded, isub(n_name, n_name) as same, case when indel_ratio(n_name, replace(n_name, ' ', '')) < 1 then 1.0D else 0.0D end as indel_is_less from _ontoloom_nation")


@query("q71_length_filter_v1", "select a.p_partkey as a, b.p_partkey as b, abs(length(a.p_name) - length(b.p_name)) <= 0.6 * greatest(length(a.p_name), length(b.p_name)) as near from part a join part b on a.p_size = b.p_size and a.p_brand = b.p_brand and a.p_partkey < b.p_partkey")
def q71(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    a, b = (p.select("p_size", "p_brand", F.col("p_partkey").alias(x), F.col("p_name").alias(f"{x}_name")) for x in "ab")
    return a.join(b, ["p_size", "p_brand"]).where("a < b").select("a", "b", A.lengths_fit(F.col("a_name"), F.col("b_name")).alias("near"))


@query("q72_predicates_of_alignments", f"select p_partkey as source, etype, case when contains(etype, 'Class') then '{OWL}equivalentClass' when contains(etype, 'Property') then '{OWL}equivalentProperty' else '{OWL}sameAs' end as predicate, case when contains(etype, 'Concept') then '{SKOS}closeMatch' when contains(etype, 'Class') then '{OWL}equivalentClass' when contains(etype, 'Property') then '{OWL}equivalentProperty' else '{OWL}sameAs' end as chosen from (select *, case p_partkey % 4 when 0 then '{CLASS}' when 1 then '{OBJECT_PROPERTY}' when 2 then '{SKOS}Concept' else '{INDIVIDUAL}' end as etype from part)")
def q72(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("source"), F.when(k == 0, CLASS).when(k == 1, OBJECT_PROPERTY).when(k == 2, SKOS + "Concept").otherwise(INDIVIDUAL).alias("etype"))
    return rows.select("source", "etype", L.predicate_of(F.col("etype")).alias("predicate"), L.predicate_of(F.col("etype"), SKOS + "closeMatch").alias("chosen"))


@query("q73_sizes", f"with {E_SQL}, c as (select count(*) filter (side = 0) as n, count(*) filter (side = 1) as m from e) select n, m, case when n > 100 and m > 100 then (n + m) / 2 else (n + m) / 4 end::double as size from c")
def q73(spark: SparkSession, sf: str) -> DataFrame:
    s, t = sides(doc_entities(spark, sf))
    known = A.sizes(s, t, Settings(medical=False))
    return spark.createDataFrame([(known.n_src, known.n_tgt, float(known.size))], "n long, m long, size double")


@query("q74_domain_by_name", UNION.join(f"select n_nationkey, '{name}' as task, {medical} as medical from nation" for name, medical in (("anatomy", "true"), ("Human-Mouse", "true"), ("conference", "false"), ("MEDline", "true"))))
def q74(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select("n_nationkey", F.explode(F.array(*[F.struct(F.lit(x).alias("task"), F.lit(domain.name_is_medical("track", x)).alias("medical")) for x in ("anatomy", "Human-Mouse", "conference", "MEDline")])).alias("x")).select("n_nationkey", "x.*")
