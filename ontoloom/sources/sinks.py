"""Alignments as TSV, Turtle and RDF/XML cells, and reports as CSV.

Each format is lines as a column; files are written by Spark's text writer, one part per partition, or
as one file with header and footer where a format needs them.
"""

from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ontoloom.config import OWL
from ontoloom.functions.labels import predicate_of, xml_escaped

# What the formats begin and end with.
TSV_HEADER = "SrcEntity\tTgtEntity\tRelation\tScore"
TTL_HEADER = "@prefix owl: <http://www.w3.org/2002/07/owl#> ."
XML_HEADER = """<?xml version="1.0" encoding="utf-8"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"
         xmlns:xsd="http://www.w3.org/2001/XMLSchema#"
         xmlns:align="http://knowledgeweb.semanticweb.org/heterogeneity/alignment#">
<align:Alignment>
  <align:xml>yes</align:xml>
  <align:level>0</align:level>
  <align:type>**</align:type>
  <align:onto1>source</align:onto1>
  <align:onto2>target</align:onto2>"""
XML_FOOTER = "</align:Alignment>\n</rdf:RDF>"
CELL = """  <align:map>
    <align:Cell rdf:about="#cell%d">
      <align:entity1 rdf:resource="%s"/>
      <align:entity2 rdf:resource="%s"/>
      <align:relation>=</align:relation>
      <align:measure rdf:datatype="http://www.w3.org/2001/XMLSchema#float">%.4f</align:measure>
    </align:Cell>
  </align:map>"""
REPORT = ["Track", "Task", "Precision", "Recall", "F1-Score", "Time (s)", "Total Time (s)", "Alignments", "Correct", "Reference", "Type"]
REPORT_V1 = ["Track", "Task", "Precision", "Recall", "F1-Score", "Time (s)", "Type"]


def _score(df: DataFrame):
    return F.col("score").cast("double") if "score" in df.columns else F.lit(1.0)


def tsv_lines(alignments: DataFrame) -> DataFrame:
    """line: source, target, '=' and the score with four decimals (1.0 where there is none)."""
    return alignments.select(F.format_string("%s\t%s\t=\t%.4f", "source", "target", _score(alignments)).alias("line"))


def _numbered(alignments: DataFrame) -> DataFrame:
    """``i``: the place from 0 in order of source and target, by counts of range partitions: no one task holds all rows."""
    parts = alignments.select("source", "target", _score(alignments).alias("score")).repartitionByRange("source", "target").sortWithinPartitions("source", "target")
    parts = parts.withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    from ontoloom.shared import written

    parts = written(parts, "numbered")
    before = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
    return parts.join(F.broadcast(before), "_part").withColumn("i", F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


def cells(alignments: DataFrame) -> DataFrame:
    """i and the lines of each alignment cell, numbered from 0 by source and target."""
    return _numbered(alignments).select("i", F.format_string(CELL, "i", xml_escaped(F.col("source")), xml_escaped(F.col("target")), "score").alias("cell"))


def _iri(c: str):
    out = F.col(c)
    for raw, code in (("<", "%3C"), (">", "%3E"), ('"', "%22")):
        out = F.replace(out, F.lit(raw), F.lit(code))
    return F.concat(F.lit("<"), out, F.lit(">"))


def turtle_lines(alignments: DataFrame) -> DataFrame:
    """source and line: one statement each, by ``predicate`` or else by type."""
    predicate = F.col("predicate") if "predicate" in alignments.columns else predicate_of(F.col("etype"))
    short = F.when(F.startswith(predicate, F.lit(OWL)), F.concat(F.lit("owl:"), F.substring(predicate, len(OWL) + 1, 1000))).otherwise(F.concat(F.lit("<"), predicate, F.lit(">")))
    return alignments.select("source", F.concat_ws(" ", _iri("source"), short, _iri("target"), F.lit(".")).alias("line"))


def _one_file(lines: DataFrame, path: str, header: str, footer: str = "", end: str = "\n") -> None:
    """Rows of one column, in their order, as one file: read by the driver a partition at a time."""
    where, file = fs.FileSystem.from_uri(path)
    where.create_dir(file.rsplit("/", 1)[0], recursive=True)
    with where.open_output_stream(file, compression=None) as out:
        out.write((header + end).encode())
        for row in lines.toLocalIterator():
            out.write((row[0] + end).encode())
        out.write(footer.encode())


def write_tsv(alignments: DataFrame, path: str) -> None:
    """One file with a header and CRLF ends, sorted by source and target."""
    _one_file(tsv_lines(alignments.orderBy("source", "target")), path, TSV_HEADER, end="\r\n")


def write_cells(alignments: DataFrame, path: str) -> None:
    _one_file(cells(alignments).orderBy("i").select("cell"), path, XML_HEADER, XML_FOOTER)


def write_turtle(alignments: DataFrame, path: str) -> None:
    _one_file(turtle_lines(alignments).orderBy("line").select("line"), path, TTL_HEADER + "\n")


def write_parts(lines: DataFrame, folder: str) -> None:
    """Lines (one column) as a folder of text parts, for alignments too large for one file."""
    lines.write.mode("overwrite").text(folder)


def write_report(report: DataFrame, path: str, v1: bool = False) -> None:
    """A CSV with 11 columns and a header, or v1's 7 columns without one."""
    columns = REPORT_V1 if v1 else REPORT
    row = F.concat_ws(",", *[F.coalesce(F.when(F.rlike(F.col(f"`{c}`").cast("string"), F.lit('[",\n]')), F.concat(F.lit('"'), F.replace(F.col(f"`{c}`").cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(f"`{c}`").cast("string")), F.lit("")) for c in columns])
    lines = report.select(row)
    if v1:
        where, file = fs.FileSystem.from_uri(path)
        with where.open_output_stream(file, compression=None) as out:
            for r in lines.toLocalIterator():
                out.write((r[0] + "\r\n").encode())
    else:
        _one_file(lines, path, ",".join(columns), end="\r\n")
