"""Nearest neighbours within an entity type.

Exact search works on tiles: each side's vectors are packed into matrices of up to TILE rows, tiles of
one type are paired, each pair is one matrix product that keeps k columns a row, and candidates from
all tiles of a source are merged by a top-k. A type of any size spreads over all executors, memory is
two tiles a task, and no pair of rows is ever a row of a table unless it is among a tile's k best.
Vectors are shuffled once to their tiles and once to the tiles' partners. For millions of targets
``ivf`` compares only with the targets of a source's nearest centroids, and ``ivfpq`` ships codes of a
few bytes in place of their vectors.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ontoloom.functions.vectors import inner_product, token_cosine
from ontoloom.shared import written

TILE = 8192
#: scores of a tile's rows that are held at once
SCORES = 1 << 22
FOUND = "etype string, source string, target string, score double"


def _tiles(rows: DataFrame, sizes: DataFrame, side: str, other: str, tile: int) -> DataFrame:
    """etype, s_tile, t_tile, k, <side> (array of uri and vec): rows dealt by a hash of their URI, once for each partner."""
    own, others = F.col(f"_n{side}"), F.col(f"_n{other}")
    placed = rows.join(sizes, "etype").withColumn("_tile", F.pmod(F.xxhash64("uri"), F.ceil(own / tile)).cast("int"))
    packed = placed.groupBy("etype", F.col("_tile").alias(f"{side}_tile"), "k", F.ceil(others / tile).cast("int").alias("_m")).agg(F.collect_list(F.struct("uri", "vec")).alias(side))
    return packed.select("etype", f"{side}_tile", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)).alias(f"{other}_tile"), "k", side)


def _matrix(rows: pa.Array, books: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """URIs in order, and vectors, which codes stand for where there are codebooks."""
    uris = np.array(rows.field("uri").to_pylist(), object)
    vec = rows.field("vec")
    if books is None:
        found = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
    else:
        codes = np.frombuffer(b"".join(vec.to_pylist()), np.uint8).reshape(len(rows), len(books))
        found = np.concatenate([book[codes[:, j]] for j, book in enumerate(books)], axis=1).astype(np.float64)
    order = np.argsort(uris, kind="stable")
    return uris[order], found[order]


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """For each row its k best columns, the smaller column first at a tie."""
    n = scores.shape[1]
    if k == 1:
        return scores.argmax(axis=1)[:, None]
    if k >= n:
        return np.argsort(-scores, axis=1, kind="stable")
    least = np.partition(scores, n - k, axis=1)[:, n - k]
    row, column = np.nonzero(scores >= least[:, None])
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return column[place < k].reshape(-1, k)


def _best(batches: Iterator[pa.RecordBatch], books: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    names = ["etype", "source", "target", "score"]
    for batch in batches:
        for i in range(batch.num_rows):
            etype = batch.column("etype")[i].as_py()
            left, a = _matrix(batch.column("s")[i].values)
            # By score, then by URI: columns are sorted by URI.
            right, b = _matrix(batch.column("t")[i].values, books)
            k, step = min(batch.column("k")[i].as_py(), len(right)), max(1, SCORES // len(right))
            for at in range(0, len(left), step):
                scores = a[at : at + step] @ b.T
                top = _top(scores, k)
                yield pa.RecordBatch.from_arrays([
                    pa.array([etype] * top.size, pa.string()), pa.array(np.repeat(left[at : at + step], k), pa.string()),
                    pa.array(right[top.ravel()], pa.string()), pa.array(np.take_along_axis(scores, top, axis=1).ravel()),
                ], names)


def ranked(found: DataFrame, per: str = "source", other: str = "target") -> DataFrame:
    """``rank`` of each row among its source's by score, ties by target."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("etype", per).orderBy(F.desc("score"), other)))


def _typed(df: DataFrame) -> DataFrame:
    return df.select("uri", F.col("etype").cast("string").alias("etype"), "vec")


def _limits(k: DataFrame) -> DataFrame:
    return k.select(F.col("etype").cast("string").alias("etype"), F.col("k").cast("int").alias("k"))


def nearest(src: DataFrame, tgt: DataFrame, k: int | DataFrame, tile: int = TILE, books: np.ndarray | None = None) -> DataFrame:
    """etype, source, target, score, rank: the k targets of the same type with the largest inner products.

    ``src``, ``tgt``: uri, etype, vec. ``k``: a number, or a table etype, k. Vectors are taken as they are; with
    ``books`` those of ``tgt`` are codes (binary) of a product quantizer.
    """
    src, tgt = _typed(src), _typed(tgt)
    count = lambda df, name: df.groupBy("etype").agg(F.count(F.lit(1)).alias(name))
    sizes = count(src, "_ns").join(count(tgt, "_nt"), "etype")
    # A row a type, written so that Spark knows its size: it is broadcast only where that is small.
    sizes = written(sizes.withColumn("k", F.lit(k)) if isinstance(k, int) else sizes.join(_limits(k), "etype"), "sizes")
    pairs = _tiles(src, sizes, "s", "t", tile).join(_tiles(tgt, sizes, "t", "s", tile).drop("k"), ["etype", "s_tile", "t_tile"])
    sent = None if books is None else src.sparkSession.sparkContext.broadcast(books)  # 256 rows of a vector's length
    found = pairs.select("etype", "s", "t", "k").mapInArrow(lambda b: _best(b, None if sent is None else sent.value), FOUND)
    out = ranked(found)
    if isinstance(k, int):
        return out.where(F.col("rank") <= k)
    return _within(out, sizes)


def _within(ranked_: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows whose rank is at most their type's k."""
    few = limits.select(F.col("etype").alias("_etype"), F.col("k").alias("_k"))
    return ranked_.join(few, (F.col("etype") == F.col("_etype")) & (F.col("rank") <= F.col("_k"))).select("etype", "source", "target", "score", "rank")


def reverse_nearest(src: DataFrame, tgt: DataFrame, forward: DataFrame, k: int | DataFrame, search=nearest) -> DataFrame:
    """source, target, rev_score of the k sources nearest to each target that was found at least once."""
    chosen = tgt.join(forward.select(F.col("target").alias("uri")).distinct(), "uri", "left_semi")
    back = search(chosen, src, k)
    return back.select("etype", F.col("target").alias("source"), F.col("source").alias("target"), F.col("score").alias("rev_score"), F.col("rank").alias("rev_rank"))


def with_reverse(forward: DataFrame, reverse: DataFrame) -> DataFrame:
    """``rev``: the reverse score of the pair, 0 where the reverse search did not return it."""
    return forward.join(reverse.select("source", "target", "rev_score"), ["source", "target"], "left").withColumn("rev", F.coalesce("rev_score", F.lit(0.0))).drop("rev_score")


def hub_counts(found: DataFrame) -> DataFrame:
    """etype, target, freq: how many sources have the target among their candidates."""
    return found.groupBy("etype", "target").agg(F.count(F.lit(1)).alias("freq"))


def _sampled(rows: DataFrame, n: int, size: int) -> DataFrame:
    """About ``size`` of n rows, by a hash of their URI."""
    return rows.where(F.pmod(F.xxhash64("uri"), F.lit(1 << 20)) < -(-(min(size, n) << 20) // max(1, n)))


def centroids(tgt: DataFrame, n: int | None = None, seed: int = 0, ratio: int = 39) -> np.ndarray:
    """Centroids of target vectors: n of them, else 4 * sqrt(rows), at least 64; k-means on about ``ratio`` rows for each."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = tgt.count()
    n = n or min(max(1, rows), int(np.clip(4 * np.sqrt(rows), 64, 16_384)))
    few = _sampled(tgt, rows, ratio * n)
    fitted = KMeans(k=max(2, n), seed=seed, maxIter=10).fit(few.select(array_to_vector(F.col("vec").cast("array<double>")).alias("features")))
    return np.array(fitted.clusterCenters())


def probes_of(cells: int, divisor: int = 16) -> int:
    """Cells that a source looks into, by default: a sixteenth of them, at least 8."""
    return max(8, min(cells, cells // divisor))


def probes_for(src: DataFrame, tgt: DataFrame, k: int, centers: np.ndarray, recall: float = 0.9, sample: int = 256, probes: int | None = None) -> tuple[int, float]:
    """(probes, measured recall): the default, doubled until about ``sample`` sources find that share of their k nearest.

    All cells give exact results, so that the doubling ends."""
    probes, few = probes or probes_of(len(centers)), written(_typed(_sampled(src, src.count(), sample)), "probing")
    exact = written(nearest(few, tgt, k).select("source", "target"), "exact")
    wanted = exact.count()
    while True:
        got = 1.0 if probes >= len(centers) or not wanted else ivf_nearest(few, tgt, k, centers, probes).join(exact, ["source", "target"]).count() / wanted
        if got >= recall:
            return min(probes, len(centers)), got
        probes *= 2


def _assigned(rows: DataFrame, centers: np.ndarray, n: int) -> DataFrame:
    """uri, etype (with a cell's number after it) and vec: a row for each of the n cells nearest to a vector."""
    sent = rows.sparkSession.sparkContext.broadcast(centers.astype(np.float32))  # at most 16,384 centroids

    def run(batches):
        cells, half = sent.value, (sent.value**2).sum(axis=1) / 2
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            step = max(1, SCORES // len(cells))
            near = np.concatenate([_top(v[i : i + step] @ cells.T - half, min(n, len(cells))) for i in range(0, len(v), step)])
            take = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
            types = batch.column("etype").to_pylist()
            keys = [f"{types[i]}\x1f{c}" for i, of in enumerate(near.tolist()) for c in of]
            yield pa.RecordBatch.from_arrays([batch.column("uri").take(take), pa.array(keys, pa.string()), batch.column("vec").take(take)], ["uri", "etype", "vec"])

    slim = rows.select("uri", F.col("etype").cast("string").alias("etype"), F.col("vec").cast("array<float>").alias("vec"))
    return slim.mapInArrow(run, "uri string, etype string, vec array<float>")


def _in_cells(src: DataFrame, tgt: DataFrame, k: int | DataFrame, tile: int, more: int = 1, books: np.ndarray | None = None) -> DataFrame:
    """nearest() of rows keyed by type and cell, merged by type; ``more`` times k of each source where scores are not exact."""
    most = k if isinstance(k, int) else k.agg(F.max("k")).first()[0] or 1
    found = nearest(src, tgt, int(most) * more, tile, books)
    out = ranked(found.select(F.substring_index("etype", "\x1f", 1).alias("etype"), "source", "target", "score"))
    return out.where(F.col("rank") <= most * more) if isinstance(k, int) or more > 1 else _within(out, _limits(k))


def ivf_nearest(src: DataFrame, tgt: DataFrame, k: int | DataFrame, centers: np.ndarray | None = None, probes: int | None = None, tile: int = TILE) -> DataFrame:
    """As nearest(), approximately: a source meets the targets of its ``probes`` nearest centroids only.

    Scores are exact; of neighbours in other cells some are missed: probes_for() measures how many."""
    centers = centroids(tgt) if centers is None else centers
    return _in_cells(_assigned(src, centers, probes or probes_of(len(centers))), _assigned(tgt, centers, 1), k, tile)


def codebooks(tgt: DataFrame, parts: int = 16, codes: int = 256, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """A product quantizer: for each of ``parts`` stretches of a vector (fewer, until they divide its length) k-means
    centroids of about 40 sampled rows a code, which is all that the driver gets."""
    sample = _sampled(tgt, tgt.count(), 40 * codes).select(F.col("vec").cast("array<float>").alias("vec")).toArrow().column("vec").combine_chunks()
    rows = np.asarray(sample.flatten()).reshape(len(sample), -1)
    parts = next(m for m in range(min(parts, rows.shape[1]), 0, -1) if rows.shape[1] % m == 0)
    rng, books = np.random.default_rng(seed), []
    for x in np.split(rows, parts, axis=1):
        book = x[rng.choice(len(x), min(codes, len(x)), replace=False)].copy()
        for _ in range(rounds):
            at = (x @ book.T - (book**2).sum(axis=1) / 2).argmax(axis=1)
            n = np.bincount(at, minlength=len(book))
            sums = np.stack([np.bincount(at, x[:, d], len(book)) for d in range(x.shape[1])], axis=1)
            book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], book).astype(np.float32)
        books.append(book)
    return np.stack(books)


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """uri, etype and vec as a code: a byte for each stretch, the nearest centroid of its codebook."""
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                v = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                codes = np.stack([(x @ book.T - (book**2).sum(axis=1) / 2).argmax(axis=1) for x, book in zip(np.split(v, len(sent.value), axis=1), sent.value, strict=True)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column("uri"), batch.column("etype"), pa.array([x.tobytes() for x in codes], pa.binary())], ["uri", "etype", "vec"])

    slim = rows.select("uri", F.col("etype").cast("string").alias("etype"), F.col("vec").cast("array<float>").alias("vec"))
    return slim.mapInArrow(run, "uri string, etype string, vec binary")


def ivfpq_nearest(src: DataFrame, tgt: DataFrame, k: int | DataFrame, centers: np.ndarray, books: np.ndarray, probes: int | None = None, more: int = 4, tile: int = TILE) -> DataFrame:
    """As ivf_nearest(), with targets as codes: ``more`` times k candidates by approximate scores, then exact ones."""
    found = _in_cells(_assigned(src, centers, probes or probes_of(len(centers))), coded(_assigned(tgt, centers, 1), books), k, tile, more, books)
    vec = lambda df, name: df.select(F.col("uri").alias(name), F.col("vec").alias(f"_{name}"))
    met = found.select("etype", "source", "target").join(vec(src, "source"), "source").join(vec(tgt, "target"), "target")
    out = ranked(met.select("etype", "source", "target", inner_product(F.col("_source"), F.col("_target")).alias("score")))
    return out.where(F.col("rank") <= k) if isinstance(k, int) else _within(out, _limits(k))


def _prefixes(rows: DataFrame, rarity: DataFrame, name: str, least: float) -> DataFrame:
    """<name>, etype, n_<name>, after_<name>, token: the rarest tokens of each entity, as many as a partner must share one
    of; ``after`` counts the less rare ones that follow, put aside or not."""
    each = rows.select(F.col("uri").alias(name), F.col("etype").cast("string").alias("etype"), F.explode("tokens").alias("token"))
    sets = each.join(rarity, ["etype", "token"]).groupBy(name, "etype").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    size = F.size("t")
    needed = F.ceil(size * (least * least) - 1e-9).cast("int")
    placed = sets.select(name, "etype", size.alias(f"n_{name}"), F.posexplode(F.slice("t", F.lit(1), size - needed + 1)).alias("at", "p"))
    return placed.select(name, "etype", f"n_{name}", (F.col(f"n_{name}") - 1 - F.col("at")).alias(f"after_{name}"), F.col("p.token").alias("token"))


def token_nearest(src: DataFrame, tgt: DataFrame, k: int | DataFrame, least: float = 0.5) -> DataFrame:
    """As nearest(), by the cosine of token sets, of pairs that reach ``least``.

    ``src``, ``tgt``: uri, etype, tokens. A pair that reaches it shares at least least**2 of either set, so it shares one
    of the rarest tokens that are left when so many less one are put aside; pairs meet on those, and frequent words,
    which would pair everything, hardly ever come to that. A token that leaves too few for a pair to reach it joins nothing.
    """
    both = src.select(F.col("etype").cast("string").alias("etype"), "tokens").unionByName(tgt.select(F.col("etype").cast("string").alias("etype"), "tokens"))
    rarity = both.select("etype", F.explode("tokens").alias("token")).groupBy("etype", "token").agg(F.count(F.lit(1)).alias("df"))
    s, t = _prefixes(src, rarity, "source", least), _prefixes(tgt, rarity, "target", least)
    # The first token that two entities share leaves at most this many for them to share; sizes too far apart fail too.
    most = 1 + F.least("after_source", "after_target")
    fits = most * most >= F.col("n_source") * F.col("n_target") * (least * least) - 1e-6
    met = s.join(t, ["etype", "token"]).where(fits).select("etype", "source", "target").distinct()
    met = met.join(src.select(F.col("uri").alias("source"), F.col("tokens").alias("_s")), "source").join(tgt.select(F.col("uri").alias("target"), F.col("tokens").alias("_t")), "target")
    found = met.select("etype", "source", "target", token_cosine(F.col("_s"), F.col("_t")).alias("score")).where(F.col("score") >= least)
    out = ranked(found)
    return out.where(F.col("rank") <= k) if isinstance(k, int) else _within(out, _limits(k))
