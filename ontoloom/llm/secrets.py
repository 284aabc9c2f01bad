"""Secret scan with an incremental ledger of blobs.

Each version of a path is a blob, named by the SHA-256 of its content. The ledger is a table of
(blob, rule_version, findings). A scan reads only blobs that the ledger lacks under the present rule
version, appends them, and joins findings back to every path that ever held the blob.

Texts are neither shuffled nor sorted to tell copies apart, only their names are: a task scans a blob
the first time that it meets it, and of what several tasks found the ledger takes one row.
"""

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.shared import new_place, unused

#: kind, pattern, group whose length counts, fewest characters, whether it is one of the contract's
RULES = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    ("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    ("hex", r"[0-9a-f]+", 0, 24, True),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, False),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 0, False),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0, False),
]
FINDINGS = "array<struct<kind:string,start:bigint,end:bigint>>"
#: what a text must hold for a rule to be worth a search
NEEDS = {"assign": (":", "="), "access": ("AKIA",), "pem": ("-----BEGIN ",), "jwt": ("eyJ",), "github": ("gh",)}
#: the same matches in one pass over the text, and the group before them. Only runs of the least length can count, maximal
#: runs never overlap, and all matches in a run end where it ends; a token's first part is looked for once a run.
AT_ONCE = {
    "access": (r"AKIA[A-Z0-9]{16,}", None),
    "hex": (r"[0-9a-f]{24,}", None),
    "jwt": (r"(?<![A-Za-z0-9_-])((?:(?!eyJ)[A-Za-z0-9_-])*+)eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]++", 1),
}
#: names of blobs that a task remembers; more are scanned again, to the same result
REMEMBERED = 1 << 17


def find(text: str, rules: list[tuple] | None = None) -> list[tuple[int, int, int, str]]:
    """(start, rank of the kind, end, kind) of every match that counts, leftmost and not overlapping within a kind."""
    out = []
    for rank, (kind, pattern, group, least, before) in enumerate(rules or _compiled()):
        if kind not in NEEDS or any(x in text for x in NEEDS[kind]):
            out += [(m.end(before) if before else m.start(), rank, m.end(), kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out)


def _compiled() -> list[tuple]:
    out = []
    for kind, pattern, group, least, _ in RULES:
        quick, before = AT_ONCE.get(kind, (pattern, None))
        out.append((kind, re.compile(quick, re.ASCII), group, least, before))
    return out


#: a rule set is named by what it says and by the code that applies it, so changed rules scan everything anew
RULE_VERSION = hashlib.sha256(repr((RULES, sorted(NEEDS.items()), sorted(AT_ONCE.items()), find.__code__.co_code, find.__code__.co_names)).encode()).hexdigest()[:16]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    rules, met = _compiled(), set()
    for batch in batches:
        names, found = [], []
        for blob, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if blob in met:
                continue
            if len(met) >= REMEMBERED:
                met.clear()
            met.add(blob)
            names.append(blob)
            found.append([{"kind": k, "start": a, "end": b} for a, _, b, k in find(text.as_py(), rules)])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, kind)], ["blob", "findings"])


def blob_of(content: Column) -> Column:
    """A blob's name: SHA-256 of its UTF-8 content; null is empty content."""
    return F.sha2(F.coalesce(content, F.lit("")), 256)


def scan_unseen(versions: DataFrame, ledger: str, content: str = "text") -> None:
    """Scans blobs of ``versions`` that the ledger (a Parquet path) lacks under RULE_VERSION, and appends them.

    Null content is the empty blob; repeated rows and copies are one blob and one row of the ledger, an empty table adds none.
    """
    spark = versions.sparkSession
    rows = versions.select(blob_of(F.col(content)).alias("blob"), F.coalesce(F.col(content), F.lit("")).alias("text"))
    seen = read_ledger(spark, ledger)
    if seen is not None:
        # Names alone decide what is unseen; texts meet only those.
        unseen = rows.select("blob").distinct().join(seen.where(F.col("rule_version") == RULE_VERSION).select("blob"), "blob", "left_anti")
        rows = rows.join(unseen, "blob", "left_semi")
    fresh = rows.select("blob", "text").mapInArrow(_scan, f"blob string, findings {FINDINGS}").groupBy("blob").agg(F.first("findings").alias("findings"))
    fresh.withColumn("rule_version", F.lit(RULE_VERSION)).write.mode("append").parquet(ledger)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame | None:
    """The ledger's rows, or None where nothing was ever scanned."""
    try:
        return spark.read.schema(f"blob string, findings {FINDINGS}, rule_version string").parquet(ledger)
    except Exception as why:
        if "PATH_NOT_FOUND" in str(why):
            return None
        raise


def known_findings(spark: SparkSession, ledger: str, blob: str, findings: str) -> DataFrame:
    """Blobs with findings under RULE_VERSION, each once: scans that ran side by side may have entered a blob twice."""
    known = read_ledger(spark, ledger).where((F.col("rule_version") == RULE_VERSION) & (F.size("findings") > 0))
    return known.groupBy(F.col("blob").alias(blob)).agg(F.first("findings").alias(findings))


def scan(versions: DataFrame, ledger: str | None = None, content: str = "text") -> DataFrame:
    """The columns of ``versions`` other than the content and any ``findings``, with ``findings`` sorted by start and kind.

    Null content is empty; a blob on many paths, or repeated rows, is reported for each. An empty table gives an empty
    one. Without ``ledger`` a new one is begun in the shared folder.
    """
    spark = versions.sparkSession
    ledger = ledger or new_place(spark, "ledger")
    scan_unseen(versions, ledger, content)
    name, blob, found = (unused(versions, x) for x in ("_name", "_blob", "_found"))
    paths = versions.withColumn(name, blob_of(F.col(content))).select(name, *[F.col(f"`{c}`") for c in versions.columns if c not in (content, "findings")])
    met = paths.join(known_findings(spark, ledger, blob, found), F.col(name) == F.col(blob), "left")
    return met.withColumn("findings", F.coalesce(found, F.array().cast(FINDINGS))).drop(name, blob, found)


def _digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base = [r[0] for r in RULES if r[4]]
    found = scan(docs)
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in base],
        F.sha2(_digest(F.filter("findings", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"), _digest(F.col("findings")).alias("spans"),
    )


def _blanked(batches: Iterator[pa.RecordBatch], found: str, mark: str) -> Iterator[pa.RecordBatch]:
    """Rows without the column ``found``, whose spans (sorted by start) are ``mark`` in the text; those that overlap are one."""
    for batch in batches:
        spans = batch.column(found)
        rest = batch.drop_columns([found])
        if spans.null_count < len(spans):
            at = rest.schema.get_field_index("text")
            texts = rest.column(at)
            changed = {}
            for i in np.flatnonzero(np.asarray(spans.is_valid())).tolist():
                text, end, out = texts[i].as_py(), 0, []
                for x in spans[i].as_py():
                    if x["start"] >= end:
                        out += [text[end : x["start"]], mark]
                    end = max(end, x["end"])
                changed[i] = "".join(out) + text[end:]
            mask = np.zeros(len(texts), bool)
            mask[list(changed)] = True
            made = pc.replace_with_mask(texts, pa.array(mask), pa.array(changed.values(), texts.type))
            rest = rest.set_column(at, rest.schema.field(at), made)
        yield rest


def redact(docs: DataFrame, mark: str = "[REDACTED]", ledger: str | None = None) -> DataFrame:
    """The same rows and columns, with every finding in ``text`` replaced by ``mark``, and ``n_chars`` brought up to date.

    Null texts stay null, repeated rows stay repeated, an empty table stays empty."""
    spark = docs.sparkSession
    ledger = ledger or new_place(spark, "ledger")
    scan_unseen(docs, ledger)
    name, blob, found = (unused(docs, x) for x in ("_name", "_blob", "_found"))
    met = docs.withColumn(name, blob_of(F.col("text"))).join(known_findings(spark, ledger, blob, found), F.col(name) == F.col(blob), "left")
    out = met.select(*[F.col(f"`{c}`") for c in docs.columns], found).mapInArrow(lambda b: _blanked(b, found, mark), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def _kind_sql(rank: int, kind: str, pattern: str, group: int, least: int, base: bool) -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    return f"select rn, '{kind}' as kind, {rank} as rank, {base} as base, {least} as least, regexp_extract_all(t, {p}) as m, regexp_extract_all(t, {p}, {group}) as g, string_split_regex(t, {p}) as s from d where regexp_matches(t, {p})"


# A match starts after all that lies before it: the pieces between matches and the matches themselves.
ORACLE = f"""
with d as (select row_number() over () as rn, doc_id, coalesce(text, '') as t from documents),
k as ({" union all ".join(_kind_sql(i, *r) for i, r in enumerate(RULES))}),
x as (select *, unnest(range(1, len(m) + 1)) as i from k),
y as (select rn, kind, rank, base, least, length(g[i]) as held, length(m[i]) as n,
  coalesce(list_sum(list_transform(s[1:i], lambda z: length(z))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: length(z))), 0) as a from x),
z as (select rn, kind, rank, base, a, kind || ':' || a::bigint || ':' || (a + n)::bigint as span from y where held >= least)
select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
  sha256(coalesce(string_agg(span, ',' order by a, rank) filter (base), '')) as base_sha256, coalesce(string_agg(span, ',' order by a, rank), '') as spans
from d left join z using (rn) group by rn, doc_id
"""
