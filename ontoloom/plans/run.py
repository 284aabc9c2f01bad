"""Benchmark runs: tasks from folders to mappings, metrics and reports."""

import time
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.config import Settings
from ontoloom.operators import domain, embed, entities, evaluate
from ontoloom.plans.align import Sizes, align
from ontoloom.shared import written
from ontoloom.sources import catalog, gold, sinks
from ontoloom.sources.rdf import read_triples

# The first version's encoder, and the knowledge-graph tasks.
V1_ENCODER = "sentence-transformers/all-MiniLM-L6-v2"
KG_TASKS = ["marvelcinematicuniverse-marvel", "memoryalpha-memorybeta", "memoryalpha-stexpanded", "starwars-swg", "starwars-swtor"]


def load_entities(spark: SparkSession, path: str, v1: bool = False, max_entities: int | None = None) -> DataFrame:
    """Entities of an ontology file, as a table in the shared folder."""
    triples = read_triples(spark, path, **({"syntaxBy": "suffix"} if v1 else {}))
    return written(entities.entities_v1(triples, max_entities) if v1 else entities.entities(triples), "entities")


def encoder_for(total: int, medical: bool, settings: Settings = Settings(), load=None) -> tuple[str, object] | None:
    """(name, what embed.encode() takes) of the sentence encoder that a task's size and domain call for; None where there
    is no library for it. ``load``: makes an encoder from a name and its longest input, in place of that library."""
    if load is None:
        if not embed.models_installed():
            return None
        load = embed.model_encoder
    name, longest = (V1_ENCODER, 128) if settings.profile == "v1" else domain.encoder_name(total, medical)
    return name, load(name, longest)


def run_task(spark: SparkSession, task: catalog.Task, out: str, settings: Settings = Settings(), encoder="auto", load=None, cache: str | None = None) -> dict:
    """Aligns one task, writes TSV, cells and Turtle under ``out``, and returns its row of the report.

    ``encoder``: "auto", the model that the task calls for, or token sets where no models are installed; else what makes
    an Encoder per worker (lambda: embed.hashed_trigrams); None: token sets. ``load``: see encoder_for().
    ``cache``: a folder where vectors are kept, by model, for other tasks and runs."""
    began, v1 = time.time(), settings.profile == "v1"
    src, tgt = (load_entities(spark, str(p), v1) for p in (task.source, task.target))
    n_src, n_tgt = src.count(), tgt.count()
    src, tgt = (entities.without_parents(df, (n_src + n_tgt) // 2, settings.parents_below) for df in (src, tgt))
    if settings.medical is None:
        settings = replace(settings, medical=domain.is_medical(src, tgt, task.track, task.name)[0])
    chosen = encoder_for(n_src + n_tgt, settings.medical, settings, load) if encoder == "auto" else None if encoder is None else ("given", encoder)
    matched, vectors = time.time(), None
    if chosen is not None:
        labels = src.select("label").unionByName(tgt.select("label"))
        vectors = embed.encode(labels, chosen[1], not v1) if cache is None else embed.encode_cached(labels, cache, chosen[0] + "_raw" * v1, chosen[1], not v1)
    found = written(align(src, tgt, settings, vectors, task.track, task.name, Sizes(n_src, n_tgt, settings.medical)), "alignment")
    seconds = time.time() - matched
    for write, suffix in ((sinks.write_tsv, "tsv"), (sinks.write_cells, "rdf"), (sinks.write_turtle, "ttl")):
        write(found, f"{out}/{task.name}.{suffix}")
    row = {"Track": task.track, "Task": task.name, "Precision": "N/A", "Recall": "N/A", "F1-Score": "N/A", "Alignments": found.count(), "Correct": "N/A", "Reference": "N/A", "Type": "Task"}
    if task.reference is not None:
        wanted = gold.read_gold_v1(spark, str(task.reference)) if v1 else gold.read_gold(spark, str(task.reference))
        m = evaluate.prf(found, wanted).first()
        if m["n_gold"]:
            row |= {"Precision": m["precision"], "Recall": m["recall"], "F1-Score": m["f1"], "Correct": m["tp"], "Reference": m["n_gold"]}
    return row | {"Time (s)": round(seconds, 2), "Total Time (s)": round(time.time() - began, 2)}


def run_all(spark: SparkSession, base: str, out: str, settings: Settings = Settings(), encoder="auto", load=None, cache: str | None = None) -> DataFrame:
    """All tasks of a folder of tracks; the report is also written to ``out``/report.csv."""
    rows = [run_task(spark, t, out, settings, encoder, load, cache) for t in catalog.tasks(Path(base), settings.profile == "v1")]
    v1 = settings.profile == "v1"
    columns = sinks.REPORT_V1 if v1 else sinks.REPORT
    report = spark.createDataFrame([tuple(str(r[c]) for c in columns) for r in rows], ", ".join(f"`{c}` string" for c in columns))
    sinks.write_report(report, f"{out}/report.csv", v1)
    return report


def evaluate_knowledge_graphs(spark: SparkSession, systems: str, track: str, settings: Settings = Settings(), report: str | None = None) -> DataFrame:
    """Partial-gold metrics of the knowledge-graph tasks whose system and reference files are found, in the tasks' order.

    ``report``: a CSV file with the columns of a benchmark report; its times are not known."""
    out = None
    for name in KG_TASKS:
        system = next((p for s in (".rdf", ".tsv") if (p := Path(systems) / f"{name}{s}").exists()), None)
        reference = catalog.find_kg_reference(Path(track), name)
        if system is None or reference is None:
            continue
        row = evaluate.prf_partial(gold.read_directed(spark, str(system)), gold.read_directed(spark, str(reference)), settings.partial_gold_compat).withColumn("task", F.lit(name))
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise FileNotFoundError(f"no system with a reference in {systems} and {track}")
    if report is not None:
        sinks.write_report(kg_report(out), report)
    return out


def kg_report(metrics: DataFrame) -> DataFrame:
    """Rows of evaluate_knowledge_graphs() under the report's names."""
    four = lambda c: F.round(c, 4).cast("string")
    values = {"Track": F.lit("knowledge-graph"), "Task": F.col("task"), "Precision": four("precision"), "Recall": four("recall"), "F1-Score": four("f1"), "Time (s)": F.lit("N/A"), "Total Time (s)": F.lit("N/A")}
    values |= {"Alignments": F.col("system_size").cast("string"), "Correct": F.col("true_positives").cast("string"), "Reference": F.col("reference_size").cast("string"), "Type": F.lit("Task")}
    return metrics.select(*[values[c].alias(c) for c in sinks.REPORT])
