"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window (10 words of an item, or a shorter item) can only occur where each of its shingles does, so
its rarest shingle is a prefix of length one that suffices. Pass one counts the items' shingles over
all documents; each window then picks its rarest one. Pass two emits the documents' places of picked
shingles, joins them on the shingle, applies the positional and length bounds, and verifies the whole
window word by word against the words around the place. A document's places of one shingle with the same
words around them are one row, so neither a word that is an item nor a line that repeats makes a row a place.

Executors sift shingles through a Bloom filter of at most 2**MAX_BITS bits, which is all that is
broadcast however many items there are; past its capacity it lets more rows through to the join, and
loses none.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ontoloom.llm import text as T
from ontoloom.shared import unused, written

WINDOW, SHINGLE = 10, 3
MAX_BITS, BITS_A_KEY, PROBES = 26, 32, 4


def _words(at: np.ndarray, data: np.ndarray) -> T.Words:
    return T.Words(at, T.lower(data), T.ALNUM)


def _shingles(words: T.Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where ``size`` words begin within a text, and their hashes."""
    if len(hashes) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    begin = np.flatnonzero(words.windows(size)[: len(hashes) - size + 1])
    return begin, T.rolled(hashes, size, size)[begin]


def _uids(words: T.Words, hashes: np.ndarray) -> np.ndarray:
    """A hash of each text's words in order; no words: zero."""
    if not len(hashes):
        return np.zeros(len(words.count), np.uint64)
    uid = T.mix(np.add.reduceat(np.append(hashes * (words.place().astype(np.uint64) * np.uint64(2) + np.uint64(1)), np.uint64(0)), words.first[:-1]))
    uid[words.count == 0] = 0  # reduceat has no empty sums
    return uid


class Bloom:
    """A filter of 64-bit keys: 2**bits bits, PROBES probes each."""

    def __init__(self, bits: int, table: np.ndarray, sizes: list[int]):
        self.bits, self.table, self.sizes = bits, table, sizes

    @staticmethod
    def probes(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
        step = T.mix(keys) | np.uint64(1)
        for i in range(PROBES):
            yield (keys + np.uint64(i) * step) >> np.uint64(64 - bits)

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Which keys may be in the filter: indexes."""
        left = np.arange(len(keys))
        for i in range(PROBES):
            k = keys[left]
            at = (k + np.uint64(i) * (T.mix(k) | np.uint64(1))) >> np.uint64(64 - self.bits)
            left = left[(self.table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        return left


def _bloom(keys: DataFrame, sizes: list[int]) -> Bloom:
    """The filter of a column ``key``. Its bits are united by executors; the driver gets at most 2**MAX_BITS of them."""
    n = keys.count()
    bits = int(np.clip(np.ceil(np.log2(max(1, n * BITS_A_KEY))), 12, MAX_BITS))

    def mark(batches):
        for batch in batches:
            got = np.unique(np.concatenate([p for p in Bloom.probes(np.asarray(batch.column(0)).view(np.uint64), bits)]))
            word = np.unique(got >> np.uint64(6))
            value = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(value, np.searchsorted(word, got >> np.uint64(6)), np.uint64(1) << (got & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(value.view(np.int64))], ["word", "value"])

    table = np.zeros(1 << max(0, bits - 6), np.uint64)
    rows = keys.select("key").mapInArrow(mark, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    table[np.asarray(rows.column("word"))] = np.asarray(rows.column("value")).view(np.uint64)
    return Bloom(bits, table.view(np.uint8), sizes)


def _sent(bloom: Bloom, spark: SparkSession):
    """The filter's parts as a broadcast: those are pickled by reference, and executors have no copy of this module."""
    return spark.sparkContext.broadcast((bloom.bits, bloom.table, bloom.sizes))


def _items(batches: Iterator[pa.RecordBatch], window: int, shingle: int) -> Iterator[pa.RecordBatch]:
    """item_id, size (words a shingle), span (words a window), place and key of each shingle of each item."""
    names = ["item_id", "uid", "size", "span", "place", "n_words", "key", "words"]
    for batch in batches:
        for part in T.chunks(batch, "text"):
            at, data = T.buffers(part.column("text"))
            words = _words(at, data)
            hashes, low = words.hashes(), words.data.tobytes()
            for i in np.flatnonzero(words.count):
                a, n = int(words.first[i]), int(words.count[i])
                span = min(window, n)
                size = min(shingle, span)
                keys = T.rolled(hashes[a : a + n], size, size)
                uid = int(T.rolled(hashes[a : a + n], n, 1)[0].view(np.int64))
                said = [low[words.start[j] : words.end[j]].decode() for j in range(a, a + n)]
                # For each place the words of the windows that its shingle may be picked for.
                near = [" ".join(said[max(0, p - span + size) : p + span]) for p in range(len(keys))]
                k = len(keys)
                full = lambda v, kind: pa.array(np.full(k, v, kind))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column("item_id")[int(i)].as_py()] * k, pa.int64()), full(uid, np.int64), full(size, np.int32), full(span, np.int32), pa.array(np.arange(k, dtype=np.int32)), full(n, np.int32), pa.array(keys.view(np.int64)), pa.array(near, pa.string())], names
                )


def _counted(batches: Iterator[pa.RecordBatch], sieve) -> Iterator[pa.RecordBatch]:
    """How often keys of the filter begin in documents, summed up over what a batch has."""
    bloom = Bloom(*sieve.value)
    for batch in batches:
        found = [np.zeros(0, np.uint64)]
        for part in T.chunks(batch, "text"):
            words = _words(*T.buffers(part.column("text")))
            hashes = words.hashes()
            for size in bloom.sizes:
                _, keys = _shingles(words, hashes, size)
                found.append(keys[bloom.has(keys)])
        keys, n = np.unique(np.concatenate(found), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])


_PLACES = pa.list_(pa.struct([("key", pa.int64()), ("whole", pa.bool_()), ("before", pa.int32()), ("words", pa.string()), ("runs", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))]))


def _placed(batches: Iterator[pa.RecordBatch], sieves, window: int) -> Iterator[pa.RecordBatch]:
    """doc_id, uid (a hash of the words), n_words and the places of the filters' keys with the words around them.

    ``sieves``: a filter of keys within windows, and one of keys that are whole windows, which need no words around.
    ``runs``: places a to b - 1 of a key, of those that have the same words around."""
    blooms = [Bloom(*x.value) for x in sieves]
    for batch in batches:
        for part in T.chunks(batch, "text"):
            words = _words(*T.buffers(part.column("text")))
            hashes, low = words.hashes(), words.data.tobytes()
            begins, ends, first = words.start, words.end, words.first
            rows: list[dict] = [{} for _ in range(part.num_rows)]
            for whole, bloom in enumerate(blooms):
                for size in bloom.sizes:
                    begin, key = _shingles(words, hashes, size)
                    k = bloom.has(key)
                    at, key = begin[k], key[k].view(np.int64)
                    owner = np.searchsorted(first, at, "right") - 1
                    a = at if whole else np.maximum(first[owner], at - window + 1)
                    b = at + size if whole else np.minimum(first[owner + 1], at + window)
                    for i, p, key_, a_, b_, before in zip(owner.tolist(), (at - first[owner]).tolist(), key.tolist(), a.tolist(), b.tolist(), (at - a).tolist(), strict=True):
                        said = " ".join([low[x:y].decode() for x, y in zip(begins[a_:b_].tolist(), ends[a_:b_].tolist(), strict=True)])
                        runs = rows[i].setdefault((key_, whole, before, said), [])
                        if runs and runs[-1]["b"] == p:
                            runs[-1]["b"] = p + 1
                        else:
                            runs.append({"a": p, "b": p + 1})
            places = [[{"key": k, "whole": bool(w), "before": n, "words": said, "runs": runs} for (k, w, n, said), runs in row.items()] for row in rows]
            uid = _uids(words, hashes)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(uid.view(np.int64)), pa.array(words.count.astype(np.int64)), pa.array(places, _PLACES)], ["doc_id", "uid", "n_words", "places"])


def prefixes(items: DataFrame, counts: DataFrame) -> DataFrame:
    """key, item_id, span, offset (of the key in the window) and words of each distinct window of each item.

    ``items``: shingles as _items makes them; ``counts``: key, n. Windows are sequences of ``span`` words; each picks
    its rarest shingle, the first one at a tie.
    """
    rows = items.join(counts, "key", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    # Each shingle lies in up to span - size + 1 windows: a window takes the least (n, place) of its shingles.
    first = F.greatest(F.lit(0), F.col("place") - F.col("span") + F.col("size"))
    last = F.least(F.col("place"), F.col("n_words") - F.col("span"))
    each = rows.withColumn("window", F.explode(F.sequence(first, last)))
    best = each.groupBy("item_id", "uid", "window").agg(F.min(F.struct("n", "place", "key", "span", "size", "words")).alias("b"))
    offset = F.col("b.place") - F.col("window")
    held = F.least(F.col("b.place"), F.col("b.span") - F.col("b.size"))
    said = F.array_join(F.slice(F.split("b.words", " "), held - offset + 1, F.col("b.span")), " ")
    return best.select(F.col("b.key").alias("key"), "item_id", F.col("b.span").alias("span"), offset.alias("offset"), said.alias("window_words")).distinct()


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_words, n_hit, items (distinct item_ids, sorted as strings) per row of ``docs``.

    Null text has no words, an item without words no window. Rows that share a doc_id are told apart by their words;
    equal rows give equal results. A null item_id counts for n_hit and has no place in ``items``. No items: no hits.
    """
    return _judged(docs, items, window, shingle).drop("uid")


def _judged(docs: DataFrame, items: DataFrame, window: int, shingle: int) -> DataFrame:
    """What contaminated() gives, and uid."""
    spark = docs.sparkSession
    schema = "item_id long, uid long, size int, span int, place int, n_words int, key long, words string"
    told = written(items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(lambda b: _items(b, window, shingle), schema), "shingles")
    sizes = sorted(r[0] for r in told.select("size").distinct().collect())  # at most SHINGLE of them
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sieve = _sent(_bloom(told.select("key").distinct(), sizes), spark)
    counts = texts.mapInArrow(lambda b: _counted(b, sieve), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    picked = written(prefixes(told, counts), "prefixes")
    whole = F.col("span") <= shingle
    fine = [_sent(_bloom(picked.where(test).select("key").distinct(), sizes), spark) for test in (~whole, whole)]
    kind = "doc_id long, uid long, n_words long, places array<struct<key:long,whole:boolean,before:int,words:string,runs:array<struct<a:int,b:int>>>>"
    placed = written(texts.mapInArrow(lambda b: _placed(b, fine, window), kind), "places")
    spread = placed.select("doc_id", "uid", F.explode("places").alias("p")).select("doc_id", "uid", "p.*").withColumn("words", F.split("words", " "))
    told = picked.withColumnRenamed("key", "_key").withColumn("_whole", whole)
    # The window begins offset words before the key and ends span words on: all of it must lie in the words around.
    bounds = (F.col("before") >= F.col("offset")) & (F.size("words") - F.col("before") + F.col("offset") >= F.col("span"))
    exact = F.array_join(F.slice("words", F.col("before") - F.col("offset") + 1, F.col("span")), " ") == F.col("window_words")
    met = spread.join(told, (F.col("key") == F.col("_key")) & (F.col("whole") == F.col("_whole")) & bounds & exact)
    covered = F.transform("runs", lambda r: F.struct((r["a"] - F.col("offset")).alias("a"), (r["b"] - 1 - F.col("offset") + F.col("span")).alias("b")))
    hits = met.groupBy(F.col("doc_id").alias("_doc"), F.col("uid").alias("_uid")).agg(F.flatten(F.collect_set(covered)).alias("_runs"), F.collect_set("item_id").alias("_items"))
    union = F.aggregate(
        F.array_sort("_runs"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["to"]))).alias("n"), F.greatest(s["to"], x["b"]).alias("to")),
        lambda s: s["n"],
    )
    hits = hits.select("_doc", "_uid", union.cast("long").alias("_n"), F.array_sort(F.transform("_items", lambda x: x.cast("string"))).alias("_items"))
    out = placed.select("doc_id", "uid", "n_words").join(hits, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("uid") == F.col("_uid")), "left")
    return out.select("doc_id", "uid", "n_words", F.coalesce("_n", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("_items", F.array().cast("array<string>")).alias("items"))


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The columns of ``docs`` without documents that hold a window of an item.

    Rows are judged each by its own words, also where they share a doc_id or have none.
    """
    uid, gone_id, gone_uid = unused(docs, "_uid"), unused(docs, "_gone"), unused(docs, "_gone_uid")
    names = [*docs.columns, uid]

    def add(batches):
        for batch in batches:
            for part in T.chunks(batch, "text"):
                words = _words(*T.buffers(part.column("text")))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_uids(words, words.hashes()).view(np.int64))], names)

    told = docs.mapInArrow(add, StructType([*docs.schema.fields, StructField(uid, LongType())]))
    gone = _judged(docs, items, WINDOW, SHINGLE).where("n_hit > 0").select(F.col("doc_id").alias(gone_id), F.col("uid").alias(gone_uid)).distinct()
    left = told.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(gone_id)) & (F.col(uid) == F.col(gone_uid)), "left_anti")
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
iw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (select distinct item_id, least(10, len(w)) as span, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as s
  from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from iw where len(w) > 0)),
spans as (select distinct span from win),
dwin as (select doc_id, i, span, array_to_string(w[i : i + span - 1], ' ') as s from (select doc_id, w, span, unnest(range(1, len(w) - span + 2)) as i from dw, spans where len(w) >= span)),
hit as (select d.doc_id, d.i, d.span, win.item_id from dwin d join win using (span, s)),
n as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + span)) as p from hit) group by doc_id),
it as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as items from hit group by doc_id)
select dw.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join n using (doc_id) left join it using (doc_id)
"""
