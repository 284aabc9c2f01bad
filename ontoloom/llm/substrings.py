"""Substring dedup by difference-cover anchors.

Anchors are runs of ANCHOR words at places of a document that are 0, 1 or 3 modulo PERIOD = 7. Any two
places have a common shift below 7 that moves both onto such places, so two documents that share
WINDOW = ANCHOR + PERIOD - 1 = 13 words share an aligned anchor inside them. Only windows around an
anchor that several documents have are hashed in full, and the smallest document of each decides.

Documents are dealt into blocks. A block sends each of its distinct hashes once, sorted and packed by
range of hash; what ranges find out comes back to the block as one bit for each hash it sent. So a
passage that a third of all documents hold costs one hash a block, and no row is made per word. A range
has about RANGE_BYTES of anchors, however many blocks there are: a phase's messages are blocks times ranges,
of RANGE_BYTES / blocks each, and become shorter than a row costs only beyond some 10**5 blocks.
Phases: *anchors* (do other blocks have it?), *windows* (has another block a smaller document?),
*removal* (the block's own texts, with both answers).
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.llm import text as T

WINDOW, PERIOD, COVER = 13, 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
#: bytes of text in a block, and fewest blocks
BLOCK_BYTES, LEAST_BLOCKS = 4 << 20, 128
#: bytes of anchors in a range (windows are up to six times as many), bytes of anchors a byte of text, and fewest ranges
RANGE_BYTES, ANCHOR_SHARE, LEAST_RANGES = 32 << 20, 0.6, 128
#: what a null doc_id counts as: larger than any
NO_ID = (1 << 63) - 1

SENT = "range int, block int, phase int, hashes binary, more binary, docs binary"
TOLD = "block int, range int, phase int, bits binary"
OUT = "doc_id long, n_words long, kept string, removed array<struct<begin:long,end:long>>"


class Block:
    """The documents of a block, and what every phase works out anew from them."""

    def __init__(self, table: pa.Table):
        # In one order however rows arrive, so that answers fit what was sent.
        table = table.select(["doc_id", "text"])
        text, ids = T.flat(table.column("text")), T.flat(table.column("doc_id"))
        self.ids = ids
        self.rank = np.asarray(ids.fill_null(NO_ID)).astype(np.int64)
        at, data = T.buffers(text)
        self.words = w = T.Words(at, data, T.NOT_SPACE)
        self.word_hashes = T.spans(data, w.start, w.end)
        self.owner, place = w.text_of(), w.place()
        n = len(w.start)
        fits = place + ANCHOR <= np.repeat(w.count, w.count)
        begin = np.flatnonzero(fits & np.isin(place % PERIOD, COVER))
        self.begin = begin
        hashes = T.rolled(self.word_hashes, ANCHOR)[begin] if n >= ANCHOR else np.zeros(0, np.uint64)
        self.anchors, self.which = np.unique(hashes, return_inverse=True)
        # Anchors that two of the block's own documents have.
        low, high = np.full(len(self.anchors), NO_ID, np.int64), np.full(len(self.anchors), -NO_ID - 1, np.int64)
        np.minimum.at(low, self.which, self.owner[begin])
        np.maximum.at(high, self.which, self.owner[begin])
        self.shared = low < high
        self.place, self.n = place, n

    def windows(self, elsewhere: np.ndarray):
        """Starts of windows around shared anchors, and for each distinct one: hashes, smallest document, members."""
        w = self.words
        hot = self.begin[(self.shared | elsewhere)[self.which]]
        mark = np.zeros(self.n, bool)
        for back in range(WINDOW - ANCHOR + 1):
            at = hot[self.place[hot] >= back] - back
            mark[at] = True
        start = np.flatnonzero(mark & (self.place + WINDOW <= np.repeat(w.count, w.count)))
        if not len(start):
            empty = np.zeros(0, np.int64)
            return start, empty.astype(np.uint64), empty.astype(np.uint32), empty, empty
        one, two = T.rolled(self.word_hashes, WINDOW)[start], T.rolled(self.word_hashes, WINDOW, 1)[start].astype(np.uint32)
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
        edge = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        member = np.empty(len(start), np.int64)
        member[order] = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(start))))
        least = np.minimum.reduceat(self.rank[self.owner[start]][order], edge)
        return start, a[edge], b[edge], least, member


def _ranges(sorted_hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the n ranges of hash a sorted array has, and the edges of each in it; nothing here is as long as n."""
    where = ((sorted_hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
    has, begin = np.unique(where, return_index=True)
    return has, np.append(begin, len(where))


def _planes(values: np.ndarray) -> bytes:
    """The bytes of integers, all first bytes first: zeros lie together and compress."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _whole(planes: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def _answers(told: pa.Table, phase: int, ranges: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One flag per hash that the block sent in a phase, in the order of ranges."""
    has, edges = ranges
    rows = told.filter(pc.equal(told.column("phase"), phase)).sort_by("range")
    if rows.num_rows != len(has) or (np.asarray(rows.column("range")) != has).any():
        raise ValueError("answers and ranges do not fit")
    # Each answer is padded to whole bytes: flags are taken from where its bytes begin.
    size = np.diff(edges)
    length = (size + 7) // 8
    every = np.unpackbits(np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint8))
    padding = (8 * (np.cumsum(length) - length)) - edges[:-1]
    return every[np.arange(int(edges[-1])) + np.repeat(padding, size)].astype(bool)


def _send(block: int, phase: int, ranges: tuple[np.ndarray, np.ndarray], hashes: np.ndarray, more: np.ndarray | None = None, docs: np.ndarray | None = None) -> pa.Table:
    has, edges = ranges
    n = len(has)
    cut = lambda x, pack: [pack(x[a:b]) if x is not None else None for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return pa.table({
        "range": pa.array(has.astype(np.int32)), "block": pa.array(np.full(n, block, np.int32)), "phase": pa.array(np.full(n, phase, np.int32)),
        "hashes": pa.array(cut(hashes, lambda x: x.tobytes()), pa.binary()), "more": pa.array(cut(more, lambda x: x.tobytes()), pa.binary()), "docs": pa.array(cut(docs, _planes), pa.binary()),
    })


def _tell(rows: pa.Table, flags: list[np.ndarray]) -> pa.Table:
    return pa.table({"block": rows.column("block"), "range": rows.column("range"), "phase": rows.column("phase"), "bits": pa.array([np.packbits(f).tobytes() for f in flags], pa.binary())})


def _apart(values: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    return np.split(values, np.cumsum(sizes)[:-1])


def _several(rows: pa.Table) -> pa.Table:
    """Of a range: which hashes of each block another block sent too."""
    got = [np.frombuffer(x, np.uint64) for x in rows.column("hashes").to_pylist()]
    every = np.concatenate(got)
    order = np.argsort(every, kind="stable")
    same = every[order][1:] == every[order][:-1]
    flag = np.zeros(len(every), bool)
    flag[order[1:][same]] = True
    flag[order[:-1][same]] = True
    return _tell(rows, _apart(flag, [len(x) for x in got]))


def _smaller(rows: pa.Table) -> pa.Table:
    """Of a range: for which windows of each block another block has a smaller document."""
    one = [np.frombuffer(x, np.uint64) for x in rows.column("hashes").to_pylist()]
    two = np.concatenate([np.frombuffer(x, np.uint32) for x in rows.column("more").to_pylist()])
    docs = np.concatenate([_whole(x, np.int64) for x in rows.column("docs").to_pylist()])
    every = np.concatenate(one)
    order = np.lexsort((two, every))
    a, b = every[order], two[order]
    edge = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    least = np.repeat(np.minimum.reduceat(docs[order], edge), np.diff(np.append(edge, len(a))))
    flag = np.empty(len(every), bool)
    flag[order] = least < docs[order]
    return _tell(rows, _apart(flag, [len(x) for x in one]))


_REMOVED = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def _kept(block: Block, removed: np.ndarray) -> pa.Table:
    w, raw = block.words, block.words.data.tobytes()
    begin, end = w.start.tolist(), w.end.tolist()
    kept = [b" ".join(raw[begin[j] : end[j]] for j in (np.flatnonzero(~removed[a:b]) + a).tolist()).decode() for a, b in zip(w.first, w.first[1:], strict=False)]
    # Runs of removed words within a text, and how many begin in texts before each.
    head, tail = removed.copy(), removed.copy()
    head[1:] &= ~removed[:-1] | (block.place[1:] == 0)
    tail[:-1] &= ~removed[1:] | (block.place[1:] == 0)
    head, tail = np.flatnonzero(head), np.flatnonzero(tail)
    runs = pa.StructArray.from_arrays([pa.array(block.place[head].astype(np.int64)), pa.array(block.place[tail].astype(np.int64) + 1)], fields=list(_REMOVED.value_type))
    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(head, w.first).astype(np.int32)), runs)
    return pa.table({"doc_id": block.ids, "n_words": pa.array(w.count.astype(np.int64)), "kept": pa.array(kept, pa.string()), "removed": spans})


def kept_texts(docs: DataFrame, blocks: int | None = None, ranges: int | None = None) -> DataFrame:
    """doc_id, n_words, kept (the words that stay, a space between them) and removed (runs of the words that go, as
    places of words from 0: begin, end past the last) per row of ``docs``.

    A word goes if a window of 13 words around it also starts in a document with a smaller doc_id. A null doc_id is
    larger than any, and rows with the same id are never smaller than one another. Null texts have no words.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if blocks is None or ranges is None:
        size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()[0] or 0
        blocks = blocks or max(LEAST_BLOCKS, -(-size // BLOCK_BYTES))
        ranges = ranges or max(LEAST_RANGES, int(size * ANCHOR_SHARE) // RANGE_BYTES + 1)
    n = ranges
    # Rows without an id, and those that share one, are dealt by their words.
    by_text = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.octet_length("text").cast("long"))
    dealt = rows.select(F.pmod(F.xxhash64("doc_id", by_text), F.lit(blocks)).cast("int").alias("block"), "doc_id", "text")

    def in_order(table: pa.Table) -> pa.Table:
        # Rows of a block come in any order; ids, then lengths and texts settle it.
        return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])

    def anchors(key: tuple, table: pa.Table) -> pa.Table:
        block = Block(in_order(table))
        return _send(key[0].as_py(), 0, _ranges(block.anchors, n), block.anchors)

    def answered(table: pa.Table, told: pa.Table) -> tuple:
        block = Block(in_order(table))
        elsewhere = _answers(told, 0, _ranges(block.anchors, n))
        return block, block.windows(elsewhere)

    def windows(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({x.split()[0]: pa.array([], pa.int32() if "int" in x else pa.binary()) for x in SENT.split(", ")})
        _, (_, one, two, least, _) = answered(table, told)
        return _send(key[0].as_py(), 1, _ranges(one, n), one, two, least)

    def removal(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "kept": pa.array([], pa.string()), "removed": pa.array([], _REMOVED)})
        block, (start, one, _, least, member) = answered(table, told)
        elsewhere = _answers(told, 1, _ranges(one, n))
        hit = elsewhere[member] | (least[member] < block.rank[block.owner[start]])
        return _kept(block, T.covered(start[hit], WINDOW, block.n))

    at = dealt.groupBy("block")
    several = at.applyInArrow(anchors, SENT).groupBy("range").applyInArrow(_several, TOLD)
    smaller = at.cogroup(several.groupBy("block")).applyInArrow(windows, SENT).groupBy("range").applyInArrow(_smaller, TOLD)
    return at.cogroup(several.unionByName(smaller).groupBy("block")).applyInArrow(removal, OUT)


def dedup(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of kept_texts()."""
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, run: n + run["end"] - run["begin"])
    return kept_texts(docs, blocks).select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, array_to_string(w[i : i + 12], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from w where len(w) >= 13)),
least as (select s, min(doc_id) as m from win group by s),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as p from win join least using (s) where m < doc_id),
x as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from w where len(w) > 0),
kept as (select x.doc_id, count(gone.p) as n_removed, string_agg(x.word, ' ' order by x.p) filter (gone.p is null) as k from x left join gone on gone.doc_id = x.doc_id and gone.p = x.p group by x.doc_id)
select w.doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(k, '')) as kept_sha256 from w left join kept using (doc_id)
"""
