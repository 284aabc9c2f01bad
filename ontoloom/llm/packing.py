"""Packing: concatenate and cut.

Pass one tokenizes each document once and writes its ids together with the task that made them and
the ids that this task had before. Totals of the tasks are summed up in order, so a document's global
offset is its task's offset plus its own within the task: no row is sorted or shuffled, and what is
gathered is one row a task. Pass two cuts every document at the multiples of the sequence length;
a piece that continues over a cut is a boundary record. Only the very last sequence needs padding.
"""

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ontoloom.llm import text as T
from ontoloom.shared import written

LENGTH, END = 2048, 1
TOKENIZER = "byte_bpe_50k.json"
#: texts tokenized at once are at most so many bytes, or one text
AT_ONCE = 1 << 20
#: bytes of ids in a batch of pieces, about
IDS_AT_ONCE = 4 << 20
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, continues boolean, ids binary"


def _encoder(name: str):
    """text -> ids as little-endian uint32. The rank table of the same vocabulary gives the same ids as the JSON
    file some five times faster; a text that holds a special token's string, or a run of blanks too long for that
    reader's stack, goes through the JSON file."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(public_tokenizers.path(name))
    special = [t.content for t in full.get_added_tokens_decoder().values()]
    plain = lambda text: np.array(full.encode(text, add_special_tokens=False).ids, "<u4")
    if name != TOKENIZER:
        return plain
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return plain(text)
        try:
            return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        except ValueError:  # a run of about a million blanks
            return plain(text)

    return ids


def _tokenized(batches: Iterator[pa.RecordBatch], name: str, end: int) -> Iterator[pa.RecordBatch]:
    encode, part, before = None, TaskContext.get().partitionId(), 0
    for batch in batches:
        encode = encode or _encoder(name)
        for piece in T.chunks(batch, "text", AT_ONCE):
            ids = [np.append(encode(t), np.uint32(end)).astype("<u4") for t in (x.as_py() or "" for x in piece.column("text"))]
            counts = np.array([len(x) for x in ids], np.int64)
            starts = before + np.cumsum(counts) - counts
            before += int(counts.sum())
            # Two bytes an id where they do, else four.
            packed = [x.astype("<u2").tobytes() if x.max() < 65536 else x.tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(np.full(len(ids), part, np.int32)), pa.array(starts), pa.array(counts), pa.array(packed, pa.binary())], ["doc_id", "part", "before", "n", "ids"])


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 6 + [pa.bool_(), pa.binary()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    for batch in batches:
        rows, held = [], 0
        for doc_id, at, n, raw in zip(*(batch.column(c) for c in ("doc_id", "at", "n", "ids")), strict=True):
            doc_id, at, n, raw = doc_id.as_py(), at.as_py(), n.as_py(), raw.as_buffer()
            ids = np.frombuffer(raw, "<u2" if raw.size == 2 * n else "<u4").astype("<u4")
            start = 0
            while start < n:
                sequence, offset = divmod(at + start, length)
                size = min(length - offset, n - start)
                rows.append((doc_id, start, size, n, sequence, offset, start > 0, ids[start : start + size].tobytes()))
                start, held = start + size, held + 4 * size
                if held >= IDS_AT_ONCE:
                    yield made(rows)
                    rows, held = [], 0
        if rows:
            yield made(rows)


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str = TOKENIZER, end: int = END) -> DataFrame:
    """One row per piece; ids: its token ids, each as a little-endian uint32; ids_crc32: their checksum.

    A null text is empty: it is the end id alone. No documents: no pieces. Repeated rows are
    packed as often as they come; a null doc_id stays null."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = written(rows.mapInArrow(lambda b: _tokenized(b, tokenizer, end), "doc_id long, part int, before long, n long, ids binary"), "tokens")
    totals = ids.groupBy("part").agg(F.sum("n").alias("total"))
    # One row for each task of pass one, summed up in order of the tasks.
    offsets = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("_offset"))
    placed = ids.join(F.broadcast(offsets), "part").select("doc_id", (F.col("before") + F.col("_offset")).alias("at"), "n", "ids")
    return placed.mapInArrow(lambda b: _cut(b, length), SCHEMA).withColumn("ids_crc32", F.crc32("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "continues")
