"""Language identification of pages by fused evidence, after Bayes.

log posterior(l) = log prior(l | host) + text score(l) + log P(declared | l), where

* the text score is the log likelihood of the page's letter trigrams under l, tempered so that a page
  counts as at most TRIGRAMS independent ones;
* P(declared | l) is how often pages whose text looks like l declare that markup language, smoothed by
  how often it is declared at all; nothing declared says nothing;
* the prior of a host is smoothed towards that of its address suffix (last label), and that towards the
  prior of all pages. All counts come from grouped sums over every page, less the page's own vote for its host.

Trigram tables are fitted on a sample of labelled texts of about MAX_ROWS rows, drawn language by language by
a hash of the row's id, so that rare languages are in it; they have as many entries as FEATURES times the
languages, whatever the corpus.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.llm import text as T
from ontoloom.llm.urlfilter import host_of
from ontoloom.shared import written

MAX_ROWS, FEATURES, TRIGRAMS = 4000, 1 << 15, 40
#: weights of the wider level in a smoothed prior, and of the overall rate of declarations
HOST_WEIGHT, SUFFIX_WEIGHT, DECLARED_WEIGHT = 8.0, 20.0, 5.0
_OPENERS = re.compile(r"(?i)<script\b|<style\b|<!--|<|&[#\w]+;")
#: what ends each opener that holds more than a tag
_CLOSERS = {"<script": re.compile("(?i)</script>"), "<style": re.compile("(?i)</style>"), "<!--": re.compile("-->")}
_TAG_END = re.compile(">")
_HTML = re.compile(r"(?i)<html\b")
_LANG = re.compile(r"""(?i)\blang\s*=\s*["']?([a-z]{2,3})(?![a-z])""")
_LETTERS = np.array([b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)], np.uint8)


def features(at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram numbers of the texts of a column, and where each text's begin; runs of blanks give none."""
    low = _LETTERS[T.lower(data)].astype(np.uint64)
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    code = (low[:-2] << np.uint64(16)) | (low[1:-1] << np.uint64(8)) | low[2:]
    place = np.arange(len(code))
    owner_end = np.repeat(at[1:], np.diff(at))[: len(code)]
    good = (place + 3 <= owner_end) & ~((low[:-2] == 0x20) & (low[1:-1] == 0x20)) & ~((low[1:-1] == 0x20) & (low[2:] == 0x20))
    chosen = place[good]
    return ((code[good] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.int64), np.searchsorted(chosen, at)


class Model:
    """Languages, sorted, and for each the log probability of every trigram number."""

    def __init__(self, langs: list[str], table: np.ndarray):
        self.langs, self.table = langs, table

    def scores(self, at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tempered log likelihoods (texts x languages) and the number of trigrams of each text."""
        numbers, first = features(at, data)
        n = np.diff(first)
        out = np.zeros((len(n), len(self.langs)))
        for j in range(len(self.langs)):
            total = np.concatenate([[0.0], np.cumsum(self.table[j][numbers], dtype=np.float64)])
            out[:, j] = total[first[1:]] - total[first[:-1]]
        return out * (np.minimum(n, TRIGRAMS) / np.maximum(n, 1))[:, None], n


def fit(labelled: DataFrame, key: str = "doc_id", max_rows: int = MAX_ROWS) -> Model:
    """Trigram tables from columns text and lang; about ``max_rows`` rows, chosen by a hash of ``key``, are read.

    Every language gets the same share of them, or all that it has. Rows without text or language do not count, repeated
    rows and a null key are drawn like others; no labelled rows give a model without languages.
    """
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    each, langs = max(1, max_rows // max(1, len(sizes))), sorted(sizes)
    # Of each language the rows whose hash is below its share; a language of few has all. Rows without a key differ by text.
    shares = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(min(1 << 20, -(-(each << 20) // sizes[lang]))))])
    place = F.pmod(F.xxhash64(key, F.when(F.col(key).isNull(), F.col("text"))), F.lit(1 << 20))
    drawn = place < F.element_at(shares, F.col("lang")) if langs else F.lit(False)
    numbers = {lang: i for i, lang in enumerate(langs)}

    def count(batches):
        for batch in batches:
            for part in T.chunks(batch, "text"):
                found, first = features(*T.buffers(part.column("text")))
                owner = np.array([numbers[x] for x in part.column("lang").to_pylist()], np.int64)
                seen, n = np.unique(np.repeat(owner, np.diff(first)) * FEATURES + found, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n.astype(np.int64))], ["cell", "n"])

    table = np.full((len(langs), FEATURES), 0.5)
    rows = known.where(drawn).select("lang", "text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table.reshape(-1)[np.asarray(rows.column("cell"))] += np.asarray(rows.column("n"))
    return Model(langs, np.log(table / table.sum(axis=1, keepdims=True)) if langs else table)


def read_page(html: str) -> tuple[str, str | None]:
    """(text without markup, declared language or None) of a page, in one pass however much is left open.

    Scripts, styles, comments, tags and entities are blanks; one that is never closed is a tag, a tag without an end is text.
    """
    said, kept, at, never = [], 0, 0, set()
    while m := _OPENERS.search(html, at):
        end = m.end() if m[0][0] == "&" else None
        for kind in (m[0].lower(), "<") if end is None else ():
            close = None if kind in never else _CLOSERS.get(kind, _TAG_END).search(html, m.end())
            if close:
                end = close.end()
                break
            # What does not end here ends nowhere after.
            never.add(kind)
        at = m.start() + 1 if end is None else end
        if end is not None:
            said += [html[kept : m.start()], " "]
            kept = end
    return "".join(said) + html[kept:], _declared(html)


def _declared(html: str) -> str | None:
    """The language that an <html> tag declares; each stretch up to the tag's end is looked at once."""
    at = 0
    while m := _HTML.search(html, at):
        end = html.find(">", m.end())
        at = len(html) if end < 0 else end
        found = _LANG.search(html, m.end(), at)
        if found:
            return found[1].lower()
    return None


def suffix_of(host: Column) -> Column:
    """The last label of a host if it is two or three letters a-z, else 'other': at most 26**2 + 26**3 + 1 values."""
    last = F.regexp_extract(host, r"(?:^|\.)([a-z]{2,3})(?::\d+)?$", 1)
    return F.when(last != "", last).otherwise(F.lit("other"))


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    langs = np.array([*model.langs, ""], object)
    for batch in batches:
        for part in T.chunks(batch, "html"):
            read = [read_page(x.as_py() or "") for x in part.column("html")]
            at, data = T.buffers(pa.array([x[0] for x in read], pa.string()))
            scores, n = model.scores(at, data)
            best = np.where(n > 0, scores.argmax(axis=1), len(model.langs)) if model.langs else np.zeros(len(n), np.int64)
            said = [langs[i] or None for i in best]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("host"), pa.array(said, pa.string()), pa.array([x[1] for x in read], pa.string()), pa.array(scores.tolist(), pa.list_(pa.float64()))], ["page_id", "host", "text_lang", "declared", "scores"]
            )


def fused(scored: DataFrame, langs: list[str]) -> DataFrame:
    """``scored`` (page_id, host, text_lang, declared, scores) with lang and confidence by the formula above."""
    k = len(langs)
    votes = F.array(*[F.sum((F.col("text_lang") == x).cast("long")) for x in langs])
    none = F.array(*[F.lit(0).cast("long")] * k)
    each = lambda f: F.array(*[f(i) for i in range(k)])
    filled = lambda c: F.transform(F.coalesce(c, none), lambda x: F.coalesce(x, F.lit(0).cast("long")))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    rows = scored.withColumn("suffix", suffix_of(F.col("host")))
    hosts = rows.groupBy("host").agg(filled(votes).alias("_h")).withColumn("_suffix", suffix_of(F.col("host")))
    sums = F.array(*[F.sum(F.col("_h")[i]) for i in range(k)])
    suffixes = hosts.groupBy("_suffix").agg(filled(sums).alias("_s"))
    every = suffixes.agg(filled(F.array(*[F.sum(F.col("_s")[i]) for i in range(k)])).alias("_g"))
    smooth = lambda own, n, weight, wide: (own + weight * wide) / (n + weight)
    # One row of totals; and tables of bounded size: suffixes and declarable languages have two or three letters.
    wide = suffixes.crossJoin(F.broadcast(every)).withColumn("_g", each(lambda i: (F.col("_g")[i] + 1.0) / (total(F.col("_g")) + float(k))))
    wide = wide.select("_suffix", each(lambda i: smooth(F.col("_s")[i], total(F.col("_s")), SUFFIX_WEIGHT, F.col("_g")[i])).alias("_wide"))
    # As a table of its own the hosts meet pages in a plain join, whose hot partitions adaptive execution can split.
    hosts = written(hosts.join(F.broadcast(wide), "_suffix").select(F.col("host").alias("_host"), "_h", "_wide"), "hosts")
    told = rows.where("declared is not null and text_lang is not null").groupBy("declared").agg(filled(votes).alias("_d"))
    of_all = told.agg(F.array(*[F.sum(F.col("_d")[i]) for i in range(k)]).alias("_n"))
    chance = F.col("_d"), F.col("_n")
    told = told.crossJoin(F.broadcast(of_all)).select(
        F.col("declared").alias("_declared"), each(lambda i: F.log(smooth(chance[0][i], chance[1][i], DECLARED_WEIGHT, (total(F.col("_d")) + 0.5) / (total(F.col("_n")) + 1.0)))).alias("_told")
    )
    met = rows.join(hosts, F.col("host") == F.col("_host"), "left").join(F.broadcast(told), F.col("declared") == F.col("_declared"), "left")
    own = lambda i: F.coalesce((F.col("text_lang") == langs[i]).cast("long"), F.lit(0).cast("long"))
    voted = F.when(F.col("text_lang").isNotNull(), 1).otherwise(0)
    prior = lambda i: F.log(smooth(F.col("_h")[i] - own(i), total(F.col("_h")) - voted, HOST_WEIGHT, F.col("_wide")[i]))
    met = met.withColumn("_log", each(lambda i: prior(i) + F.col("scores")[i] + F.coalesce(F.col("_told")[i], F.lit(0.0))))
    top = F.array_max("_log")
    met = met.withColumn("_at", F.array_position("_log", top)).withColumn("_sum", F.aggregate("_log", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("_log"))))
    return met.select("page_id", "host", "suffix", "declared", "text_lang", F.element_at(F.array(*[F.lit(x) for x in langs]), F.col("_at").cast("int")).alias("lang"), F.round(1.0 / F.col("_sum"), 6).alias("confidence"))


def identify(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, host, suffix, declared, text_lang, lang, confidence per row of ``pages`` (page_id, url, html).

    Null html has no text and declares nothing, a null url has the empty host: the priors decide. A model without
    languages gives null. Repeated rows vote and are answered as often as they come.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), "html")
    scored = rows.mapInArrow(lambda b: _scored(b, model), "page_id long, host string, text_lang string, declared string, scores array<double>")
    if not model.langs:
        empty = F.lit(None).cast("string")
        return scored.select("page_id", "host", suffix_of(F.col("host")).alias("suffix"), "declared", "text_lang", empty.alias("lang"), F.lit(None).cast("double").alias("confidence"))
    return fused(written(scored, "scored"), model.langs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), fit(spark.read.parquet(f"{sf_dir}/documents.parquet")))
