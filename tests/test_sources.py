import pytest

from ontoloom.config import CLASS, CONCEPT, INDIVIDUAL, OBJECT_PROPERTY, OWL, RDF, RDFS, SKOS, Settings
from ontoloom.operators import embed
from ontoloom.operators import entities as E
from ontoloom.plans import run
from ontoloom.sources import catalog, gold, rdf, sinks

TTL = """@prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
@prefix skos: <http://www.w3.org/2004/02/skos/core#> . @prefix : <http://x#> .
# a comment
:A a owl:Class ; rdfs:label "Heart valve"@en , 'Herzklappe'@de ; rdfs:subClassOf :B , [ a owl:Restriction ; owl:onProperty :p ] .
:B a owl:Class, skos:Concept ; skos:prefLabel \"\"\"Valve "of" things\"\"\"@en ; :n 4 , 2.5 , true .
:p a owl:ObjectProperty ; rdfs:label "has part" . <http://x#i> a :A ; skos:altLabel "eye"@es ; :list ( :A "x" ) .
<http://x/%41b> a owl:Class . _:b a owl:Class ; rdfs:label "blank"@en .
"""
XML = """<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xml:base="http://x">
<owl:Class rdf:about="#A"><rdfs:label xml:lang="en">Heart valve</rdfs:label><rdfs:subClassOf rdf:resource="#B"/><rdfs:subClassOf><owl:Restriction/></rdfs:subClassOf></owl:Class>
<rdf:Description rdf:about="http://x#B"><rdf:type rdf:resource="http://www.w3.org/2002/07/owl#Class"/></rdf:Description></rdf:RDF>"""
OFN = """Prefix(:=<http://x#>) Prefix(rdfs:=<http://www.w3.org/2000/01/rdf-schema#>)
Ontology(<http://x> Declaration(Class(:A)) Declaration(ObjectProperty(:p)) AnnotationAssertion(rdfs:label :A "Heart valve"@en) SubClassOf(:A :B) SubClassOf(:A ObjectSomeValuesFrom(:p :B)))"""
OMN = """Prefix: : <http://x#>
Prefix: rdfs: <http://www.w3.org/2000/01/rdf-schema#>
Ontology: <http://x>
Class: :A
    Annotations: rdfs:label "Heart valve"@en
    SubClassOf: :B, :p some :B
ObjectProperty: :p
"""


def test_syntaxes_agree_on_what_they_share():
    for text, syntax in ((TTL, "turtle"), (XML, "rdfxml"), (OFN, "functional"), (OMN, "manchester")):
        assert rdf.sniff(text) == syntax
        found = {t[:4] for t in rdf.parse(text)}
        assert ("http://x#A", True, RDF + "type", CLASS) in found, syntax
        assert ("http://x#A", True, RDFS + "label", "Heart valve") in found and ("http://x#A", True, RDFS + "subClassOf", "http://x#B") in found
    assert rdf.sniff("nothing") == "unknown"
    with pytest.raises(rdf.SyntaxProblem):
        rdf.parse("garbage { that is no ontology")


def test_turtle_details():
    found = list(rdf.turtle(TTL))
    assert ("http://x#B", True, SKOS + "prefLabel", 'Valve "of" things', "literal", "en", None) in found
    assert [t[6].rsplit("#")[1] for t in found if t[2] == "http://x#n"] == ["integer", "decimal", "boolean"]
    assert sum(t[2] == RDF + "first" for t in found) == 2
    with pytest.raises(rdf.SyntaxProblem):
        list(rdf.turtle("<a> <b> ."))


def test_entities_from_files(spark, tmp_path):
    (tmp_path / "o.ttl").write_text(TTL)
    rows = {r.uri: r for r in E.entities(rdf.read_triples(spark, str(tmp_path / "o.ttl"))).collect()}
    assert (rows["http://x#A"].label, rows["http://x#A"].etype, rows["http://x#A"].parents) == ("heart valve", CLASS, ["http://x#B"])
    assert rows["http://x#B"].etype == CONCEPT and rows["http://x#B"].label == "valve of things"
    assert rows["http://x#p"].etype == OBJECT_PROPERTY and rows["http://x#i"].etype == INDIVIDUAL
    assert rows["http://x#i"].label == "i" and rows["http://x/%41b"].label == "b"  # altLabel in Spanish does not count
    assert not any(u.startswith("_:") for u in rows)
    assert "blank" in {r.label for r in E.entities(rdf.read_triples(spark, str(tmp_path / "o.ttl")), strict=False).collect()}
    v1 = {r.uri: r for r in E.entities_v1(rdf.read_triples(spark, str(tmp_path / "o.ttl"), syntaxBy="suffix")).collect()}
    assert v1["http://x#p"].etype == OBJECT_PROPERTY and v1["http://x#i"].etype == INDIVIDUAL
    assert E.entities_v1(rdf.read_triples(spark, str(tmp_path / "o.ttl")), 2).count() == 2


def test_source_of_folders_filters_and_garbage(spark, tmp_path):
    (tmp_path / "a.ttl").write_text(TTL)
    (tmp_path / "b.nt").write_text('<http://y> <http://p> "l\\n1"@EN .\n# c\n<http://y> <http://q> <http://z> .\n')
    df = rdf.read_triples(spark, str(tmp_path))
    assert df.where("predicate = 'http://p'").collect()[0].lang == "en"
    assert df.where("subject = 'http://y'").count() == 2
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    assert {r.object for r in rdf.read_triples(spark, str(tmp_path)).where(f"predicate = '{RDFS}label'").collect()} == {"Heart valve", "Herzklappe", "has part", "blank"}
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    (tmp_path / "c.owl").write_text("garbage { no")
    assert rdf.read_triples(spark, str(tmp_path), onError="skip").where("subject = 'http://y'").count() == 2
    with pytest.raises(Exception, match="no syntax fits"):
        rdf.read_triples(spark, str(tmp_path)).count()


def test_gold_formats(spark, tmp_path):
    w = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    eq, same = OWL + "equivalentClass", OWL + "sameAs"
    rows = lambda df: {tuple(r) for r in df.collect()}
    assert rows(gold.read_gold(spark, w("a.tsv", "Relation\tTgtEntity\tSrcEntity\nsameAs\tb\ta\n=\t d \tc\n\te\t\n"))) == {("a", same, "b"), ("c", eq, "d")}
    assert rows(gold.read_gold(spark, w("b.csv", "z,y\nq,r,x\nonly\n"))) == {("y", eq, "z"), ("q", eq, "r")}
    assert rows(gold.read_gold(spark, w("c.nt", '# c\n<u> <p> <t> .\n<u> <p> "lit" .\n'))) == {("t", "p", "u")}
    cells = w("d.rdf", sinks.XML_HEADER + "\n" + sinks.CELL % (0, "http://s?a&amp;b", "http://t", 0.5) + "\n" + sinks.XML_FOOTER)
    assert rows(gold.read_gold(spark, cells)) == {("http://s?a&b", eq, "http://t")}
    assert rows(gold.read_directed(spark, cells)) == {("http://s?a&b", "http://t")}
    ttl = w("e.ttl", "@prefix owl: <http://www.w3.org/2002/07/owl#> .\n<http://b> owl:sameAs <http://a> .\n<http://a> a owl:Class ; owl:unionOf <http://c> .\n")
    assert rows(gold.read_gold(spark, ttl)) == {("http://a", same, "http://b"), ("http://a", OWL + "unionOf", "http://c")}
    assert rows(gold.read_gold_v1(spark, ttl)) == {("http://a", same, "http://b")} and rows(gold.read_directed(spark, ttl)) == {("http://b", "http://a")}


def test_sinks_can_be_read_again(spark, tmp_path):
    df = spark.createDataFrame([(f"http://s?{i}&<\"", f"http://t{i}", OWL + "Class", i / 7) for i in range(25)], "source string, target string, etype string, score double")
    for name, write in (("x.tsv", sinks.write_tsv), ("x.rdf", sinks.write_cells)):
        write(df, str(tmp_path / name))
        assert {tuple(r) for r in gold.read_directed(spark, str(tmp_path / name)).collect()} == {(r.source, r.target) for r in df.collect()}
    raw = (tmp_path / "x.tsv").read_bytes()
    assert raw.startswith(b"SrcEntity\tTgtEntity\tRelation\tScore\r\n") and b"\t=\t0.1429\r\n" in raw
    assert [f'"#cell{i}"' in (tmp_path / "x.rdf").read_text() for i in (0, 24, 25)] == [True, True, False]
    sinks.write_turtle(df.selectExpr("'http://a' source", "target", "etype"), str(tmp_path / "x.ttl"))
    assert gold.read_gold(spark, str(tmp_path / "x.ttl")).count() == 25


def test_tasks_end_to_end(spark, tmp_path):
    track = tmp_path / "tracks" / "conference"
    (track / "ontologies").mkdir(parents=True)
    (track / "references").mkdir()
    (track / "ontologies" / "one.ttl").write_text(TTL)
    (track / "ontologies" / "two.owl").write_text(XML.replace("http://x", "http://y"))
    (track / "references" / "one-two.ttl").write_text("<http://x#A> <http://www.w3.org/2002/07/owl#equivalentClass> <http://y#A> .\n")
    assert [t.name for t in catalog.tasks(tmp_path / "tracks")] == ["one-two"]
    report = run.run_all(spark, str(tmp_path / "tracks"), str(tmp_path / "out"), Settings(medical=False))
    row = report.first()
    assert row["Correct"] == "1" and row["Recall"] == "1.0"
    assert (tmp_path / "out" / "report.csv").read_text().splitlines()[0] == ",".join(sinks.REPORT)
    assert "http://x#A\thttp://y#A\t=\t1.0000" in (tmp_path / "out" / "one-two.tsv").read_text()
    v1 = run.run_all(spark, str(tmp_path / "tracks"), str(tmp_path / "v1"), Settings(profile="v1"))
    # Where models are there, a task takes the one that its size and domain call for, and keeps its vectors.
    asked = []

    def load(name, longest):
        asked.append((name, longest))
        return lambda: embed.hashed_trigrams

    for settings in (Settings(medical=True), Settings(profile="v1")):
        again = run.run_all(spark, str(tmp_path / "tracks"), str(tmp_path / "models"), settings, load=load, cache=str(tmp_path / "cache")).first()
        assert again["Precision"] != "N/A"
    assert asked == [("BAAI/bge-m3", 64), (run.V1_ENCODER, 128)]
    assert spark.read.parquet(str(tmp_path / "cache")).select("model").distinct().count() == 2
    assert run.encoder_for(5000, True, load=lambda *x: x)[1][0].endswith("SapBERT-from-PubMedBERT-fulltext") and run.encoder_for(5000, False, load=lambda *x: x)[1] == ("sentence-transformers/all-MiniLM-L12-v2", 128)
    assert v1.columns == sinks.REPORT_V1 and not (tmp_path / "v1" / "report.csv").read_text().startswith("Track")


def test_other_ways_to_find_tasks(tmp_path):
    a, b, c = (tmp_path / x for x in ("bio-ml", "pair", "siblings"))
    for d in (a, b, c):
        d.mkdir()
    for p in (a / "ncit.owl", a / "doid.owl", a / "refs_equiv" / "full.tsv", a / "refs_equiv" / "train.csv", b / "x.owl", b / "y.owl", b / "refs" / "y-x.csv", c / "m.ttl", c / "n.rdf", c / "m-n.rdf", c / "other.rdf"):
        p.parent.mkdir(exist_ok=True)
        p.write_text("")
    found = {t.name: t for t in catalog.tasks(tmp_path)}
    assert set(found) == {"ncit-doid", "x-y", "m-n"} and found["x-y"].reference == b / "refs" / "y-x.csv" and found["m-n"].reference == c / "m-n.rdf"
    assert found["ncit-doid"].reference == a / "refs_equiv" / "full.tsv"
    (a / "refs_equiv" / "ncit-doid.tsv").write_text("")
    assert catalog.find_table_reference(a, "doid-ncit").name == "ncit-doid.tsv"
    assert catalog.find_kg_reference(c, "n-m").name == "m-n.rdf" and list(catalog.tasks(tmp_path, v1=True)) == []


def test_references_beside_ontologies(tmp_path):
    track = tmp_path / "anatomy"
    (track / "ontologies").mkdir(parents=True)
    for name in ("human.owl", "mouse.rdf", "a.xml", "b.ttl"):
        (track / "ontologies" / name).write_text("")
    for name in ("anatomy-human-mouse.ttl", "a-b.ttl", "a-b-c.ttl", "plain.ttl"):
        (track / name).write_text("")
    for v1 in (False, True):
        assert [(t.name, t.source.name, t.target.name) for t in catalog.tasks(tmp_path, v1)] == [("a-b", "a.xml", "b.ttl"), ("anatomy-human-mouse", "human.owl", "mouse.rdf")]


def test_places_of_kg_references(tmp_path):
    w = lambda *parts: ((tmp_path.joinpath(*parts[:-1])).mkdir(parents=True, exist_ok=True), tmp_path.joinpath(*parts).write_text(""))
    find = lambda: (p := catalog.find_kg_reference(tmp_path, "m-n")) and str(p.relative_to(tmp_path))
    assert find() is None
    # From the last place that is looked at to the first.
    for parts in (("n-m", "ontologies", "full.tsv"), ("m-n", "refs", "ref-align.rdf"), ("m-n", "onto1-onto2.ttl"), ("refs_equiv", "train.tsv"), ("m-n", "references", "n-m.csv"), ("m-n", "m-n.owl"), ("reference", "n-m.ttl"), ("m-n.xml",)):
        w(*parts)
        assert find() == "/".join(parts)


def test_kg_evaluation(spark, tmp_path):
    (tmp_path / "starwars-swg.tsv").write_text("SrcEntity\tTgtEntity\na\tb\nc\td\n")
    refs = tmp_path / "kg" / "references"
    refs.mkdir(parents=True)
    (refs / "starwars-swg.tsv").write_text("a\tb\n")
    report = tmp_path / "kg_eval_report.csv"
    row = run.evaluate_knowledge_graphs(spark, str(tmp_path), str(tmp_path / "kg"), report=str(report)).first()
    assert (row.true_positives, row.ignored, row.task) == (1, 1, "starwars-swg")
    back = spark.read.option("header", True).csv(str(report))
    assert back.columns == sinks.REPORT and [tuple(r) for r in back.collect()] == [("knowledge-graph", "starwars-swg", "1.0", "1.0", "1.0", "N/A", "N/A", "2", "1", "1", "Task")]


def test_ntriples_are_cut_at_lines(spark, tmp_path):
    place = tmp_path / "big.nt"
    lines = [f'<http://x#{i}> <http://p> "{"é" * (i % 13)}" .' for i in range(60)] + ["", "# c", "no triple at all"]
    place.write_text("\n".join(lines))
    for size in (1, 7, 64, 1000, 1 << 20):
        rows = rdf.read_triples(spark, str(place), splitBytes=str(size), onError="skip").collect() if size > 7 else None
        if rows is not None:
            assert sorted((r.subject, r.object) for r in rows) == sorted((f"http://x#{i}", "é" * (i % 13)) for i in range(60))
        reader = rdf._Reader({"path": str(place), "splitbytes": str(size)})
        cut = [line for part in reader.partitions() for line in reader._lines(*part.value)]
        assert [x.decode() for x in cut] == lines
    with pytest.raises(Exception, match="n-triples"):
        rdf.read_triples(spark, str(place)).collect()
    (tmp_path / "none.nt").write_text("")
    assert rdf.read_triples(spark, str(tmp_path / "none.nt")).count() == 0
