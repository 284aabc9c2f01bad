"""Near duplicates by SimHash, with tables of distances to reference fingerprints (pivots).

Equal fingerprints are one vertex. Its pivot table, the Hamming distances to sixteen reference fingerprints, is
computed once and stored with it. A pair whose distances to any pivot differ by more than RADIUS = 2 is discarded,
by the triangle inequality, and only survivors are verified by exclusive or.

Which pairs are looked at: two fingerprints that differ in at most two of 64 bits agree wholly on at least two of four
16-bit quarters, so they meet under one of six keys (two quarters each). A key of more than HOT prints is not compared
but split again by quarters of the 32 bits that it leaves free, and once more by quarters of the last 16; with 56 bits
fixed a key has at most 2**8 prints. So no task compares more than HOT prints with each other, however many share a key.
Each group yields a spanning forest of its links, never all pairs, and forests are joined to components by rounds of
small tables in the shared folder.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ontoloom.llm import text as T
from ontoloom.shared import discard, place_of, unused, written

SHINGLE, SEED, RADIUS, PIVOTS = 3, 42, 2, 16
#: which two of the four quarters make each key
PICKS = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
#: a key of more prints is split; the last level's keys cannot have more
HOT, LEVELS = 256, 3
#: links that are held before they are reduced to a forest
HELD = 1 << 20
MET = "u long, v long, path int, fixed long, print long, low long, high long"


def fixed_masks() -> list[np.ndarray]:
    """For each level, by path (which picks were taken, as a number to base 6), the bits that a key fixes."""

    def below(free: list[int], fixed: int, level: int) -> list[tuple[int, int]]:
        quarter = len(free) // 4
        parts, out = [free[i * quarter : (i + 1) * quarter] for i in range(4)], []
        for pick in PICKS:
            mask = fixed | sum(1 << bit for i in pick for bit in parts[i])
            rest = [bit for i in range(4) if i not in pick for bit in parts[i]]
            out += [(level, mask), *(below(rest, mask, level + 1) if level + 1 < LEVELS else [])]
        return out

    every = below(list(range(64)), 0, 0)
    # Depth first, so within a level masks come in order of path.
    return [np.array([mask for at, mask in every if at == level], np.uint64).view(np.int64) for level in range(LEVELS)]


def references(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints far from each other: rows of the 64-bit Hadamard code, from the parity of index and row."""
    bits = np.arange(64, dtype=np.uint64)
    rows = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(3)
    return np.array([int(sum(1 << int(b) for b in bits if bin(int(r) & int(b)).count("1") & 1)) for r in rows], np.uint64)


def pivot_table(print_: Column) -> tuple[Column, Column]:
    """Distances to the references, a byte each, the first eight in one long and the others in another."""
    far = [F.bit_count(print_.bitwiseXOR(F.lit(r))).cast("long") for r in references().view(np.int64).tolist()]
    packed = []
    for half in (far[: PIVOTS // 2], far[PIVOTS // 2 :]):
        out = half[0]
        for i, x in enumerate(half[1:], 1):
            out = out.bitwiseOR(F.shiftleft(x, 8 * i))
        packed.append(out)
    return packed[0], packed[1]


def fingerprint(text: bytes) -> int:
    """The SimHash of one text's words, A-Z lower-cased; no words: zero."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    size = min(SHINGLE, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], "<u8")
    n, ones = len(hashes), np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        ones += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _column(texts: pa.Array) -> pa.Array:
    """The fingerprints of a column of texts, as signed longs."""
    at, data = T.buffers(texts)
    raw, at = data.tobytes(), at.tolist()
    return pa.array(np.array([fingerprint(raw[a:b]) for a, b in zip(at, at[1:], strict=False)], np.uint64).view(np.int64))


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _column(batch.column("text"))], ["doc_id", "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and print (the 64 bits as a signed long) of each row; null text has no words."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_prints, "doc_id long, print long")


def _forest(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
    """The smallest member of each of n rows' components, given those so far and more links."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        low, high = np.minimum(x, y)[apart], np.maximum(x, y)[apart]
        np.minimum.at(root, high, low)
        while True:
            after = root[root]
            if (after == root).all():
                break
            root = after


def links(key: np.ndarray, prints: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prints u and v of a spanning forest of the links within each run of equal ``key``.

    ``table``: distances to the pivots (rows x PIVOTS); each run is sorted by the first of them, so that a row's partners
    are the rows that follow while it differs by at most RADIUS. The other pivots prune, exclusive or verifies."""
    n, root = len(key), np.arange(len(key))
    stop = np.searchsorted(key, key, "right") if n else np.zeros(0, np.int64)
    alive, step, held = np.arange(n), 0, []
    while True:
        step += 1
        alive = alive[alive + step < stop[alive]]
        alive = alive[table[alive + step, 0] - table[alive, 0] <= RADIUS]
        if not len(alive):
            break
        left = alive[(np.abs(table[alive + step] - table[alive]) <= RADIUS).all(axis=1)]
        near = left[np.bitwise_count(prints[left] ^ prints[left + step]) <= RADIUS]
        held.append((near, near + step))
        if sum(len(x) for x, _ in held) > HELD:
            root, held = _forest(n, *(np.concatenate(x) for x in zip(*held, strict=True)), root), []
    if held:
        root = _forest(n, *(np.concatenate(x) for x in zip(*held, strict=True)), root)
    child = np.flatnonzero(root != np.arange(n))
    return prints[child], prints[root[child]]


def _met(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
    """Rows (path, fixed, print, low, high) sorted by key and first pivot -> links u > v, and the rows of keys that have
    more than HOT, under the next level's keys. At most HOT rows of a key are held."""
    names, masks = [x.split()[0] for x in MET.split(", ")], fixed_masks()
    kept, hot = None, None

    def solve(rows):
        path, fixed, prints, low, high = rows
        table = np.stack([low, high], axis=1).view(np.uint8).astype(np.int8)
        # Path and fixed bits as one number of the run.
        run = np.cumsum(np.concatenate([[False], (path[1:] != path[:-1]) | (fixed[1:] != fixed[:-1])]))[: len(path)]
        u, v = (x.view(np.int64) for x in links(run, prints.view(np.uint64), table))
        none = [pa.nulls(len(u), pa.int32()), *[pa.nulls(len(u), pa.int64())] * 4]
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v)), *none], names)

    def again(rows):
        path, _, *rest = rows
        for k in range(len(PICKS)):
            below = path * len(PICKS) + k
            at = [pa.array(x) for x in (below.astype(np.int32), rest[0] & masks[level + 1][below], *rest)]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(path), pa.int64()), pa.nulls(len(path), pa.int64()), *at], names)

    for batch in batches:
        rows = [np.asarray(batch.column(i)) for i in range(5)]
        if hot is not None:
            same = int(((rows[0] == hot[0]) & (rows[1] == hot[1])).sum())
            if same:
                yield from again([x[:same] for x in rows])
                rows = [x[same:] for x in rows]
        if not len(rows[0]):
            continue
        hot = None
        if kept is not None:
            rows = [np.concatenate(x) for x in zip(kept, rows, strict=True)]
        edge = np.flatnonzero(np.concatenate([[True], (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])]))
        size = np.diff(np.append(edge, len(rows[0])))
        many = np.repeat(size > HOT, size)
        # The last key may go on in the next batch: it waits, or is known to be hot.
        kept = None
        if size[-1] > HOT:
            hot = (rows[0][-1], rows[1][-1])
        else:
            kept = [x[edge[-1] :].copy() for x in rows]
            many, rows = many[: edge[-1]], [x[: edge[-1]] for x in rows]
        if many.any():
            yield from again([x[many] for x in rows])
        yield solve([x[~many] for x in rows])
    if kept is not None:
        yield solve(kept)


def pairs(prints: DataFrame) -> DataFrame:
    """Edges (u > v, fingerprints) that span the components within every key; ``prints``: column print, each once.

    No prints, or none with a partner, give no edges."""
    low, high = pivot_table(F.col("print"))
    masks = fixed_masks()[0].tolist()
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("path"), F.col("print").bitwiseAND(F.lit(m)).alias("fixed")) for k, m in enumerate(masks)]))
    told = prints.select("print", low.alias("low"), high.alias("high")) if "low" not in prints.columns else prints.select("print", "low", "high")
    rows = told.select(keys.alias("k"), "print", "low", "high").select("k.path", "k.fixed", "print", "low", "high")
    edges = None
    for level in range(LEVELS):
        first = F.col("low").bitwiseAND(F.lit(255))
        sorted_ = rows.repartition(F.col("path"), F.col("fixed")).sortWithinPartitions("path", "fixed", first)
        met = written(sorted_.mapInArrow(lambda b, level=level: _met(b, level), MET), "links")
        found = met.where("u is not null").select("u", "v")
        edges = found if edges is None else edges.unionByName(found)
        rows = met.where("u is null").select("path", "fixed", "print", "low", "high")
        if level + 1 == LEVELS or rows.isEmpty():
            break
    return edges


def components(edges: DataFrame) -> DataFrame:
    """vertex, component (its smallest vertex) of every vertex that has an edge (u > v).

    Rounds of large star and small star: each moves edges to smaller neighbours and sums up map-side by min;
    none gathers a vertex's neighbours. Each round is a table in the shared folder.
    """
    edges = written(edges.distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "x")
        met = large.join(low, F.col("u") == F.col("x"))
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(low.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct()
        after = written(small, "edges")
        # Done once every vertex has one edge and no vertex is both a child and a parent.
        state = after.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        if after.isEmpty():
            break
        parents = after.select(F.col("v").alias("u")).distinct()
        busy = state.where("n > 1").select("u").unionByName(state.join(parents, "u", "left_semi").select("u"))
        done = busy.isEmpty()
        discard(place_of(edges))
        edges = after
        if done:
            break
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component")) if not after.isEmpty() else after.select(F.col("u").alias("vertex"), F.col("v").alias("component"))


def _leads(prints: DataFrame) -> DataFrame:
    """_print, _component, _lead of each distinct fingerprint of ``prints`` (doc_id, print): the smallest fingerprint of
    its component, which names that one alone, and the component's smallest doc_id, null where no row of it has one."""
    low, high = pivot_table(F.col("print"))
    vertices = written(prints.groupBy("print").agg(F.min("doc_id").alias("least")).withColumns({"low": low, "high": high}), "vertices")
    # Documents that share an id have several fingerprints: only these tell vertices apart.
    found = components(pairs(vertices))
    named = vertices.join(found, F.col("print") == F.col("vertex"), "left").select("print", "least", F.coalesce("component", "print").alias("_component"))
    lead = named.groupBy(F.col("_component").alias("_c")).agg(F.min("least").alias("_lead"))
    return named.join(lead, F.col("_component") == F.col("_c")).select(F.col("print").alias("_print"), "_component", "_lead")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, print and component_id (the smallest doc_id reachable over links of distance <= RADIUS) per row.

    Repeated rows repeat. A null doc_id has a fingerprint and takes part, but names a component only if no row of it
    has an id: then component_id is null. Components whose smallest ids are the same are apart by their prints. Texts without words have fingerprint zero and are linked like others.
    """
    prints = written(fingerprints(docs), "prints")
    met = prints.join(_leads(prints), F.col("print") == F.col("_print"))
    return met.select("doc_id", "print", F.col("_lead").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, one row of each component: that with the smallest doc_id, any one of them where rows
    repeat or share it, and any one where no row has an id.

    Rows are told apart by numbers that are stored with them, so rows that share an id are judged each by its own text.
    """
    number, print_ = unused(docs, "_row"), unused(docs, "_print")
    names = [*docs.columns, print_]

    def add(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _column(batch.column("text"))], names)

    stored = docs.mapInArrow(add, StructType([*docs.schema.fields, StructField(print_, LongType())])).withColumn(number, F.monotonically_increasing_id())
    stored = written(stored, "numbered")
    slim = stored.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(print_).alias("print"), F.col(number).alias("row"))
    met = slim.join(_leads(slim), F.col("print") == F.col("_print"))
    first = F.min(F.when((F.col("doc_id") == F.col("_lead")) | F.col("_lead").isNull(), F.col("row")))
    stay = met.groupBy("_component").agg(first.alias(unused(stored, "_stay"))).select(unused(stored, "_stay"))
    return stored.join(stay, F.col(number) == F.col(unused(stored, "_stay")), "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
