import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ontoloom.config import CLASS, INDIVIDUAL, OWL, Settings
from ontoloom.operators import domain, embed, evaluate, knn, resolve
from ontoloom.plans import align as A


def entities(spark, rows):
    return spark.createDataFrame([(u, lb, t, None) for u, lb, t in rows], "uri string, label string, etype string, parents array<string>")


def vectors(spark, n, seed, etype="t"):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(f"{seed}-{i}", etype if i % 3 else "other", rng.normal(size=8).tolist()) for i in range(n)], "uri string, etype string, vec array<double>")


def test_nearest_equals_brute_force_whatever_the_tiles(spark):
    s, t = vectors(spark, 40, 1), vectors(spark, 50, 2)
    sv, tv = [r.asDict() for r in s.collect()], [r.asDict() for r in t.collect()]
    want = set()
    for a in sv:
        best = sorted(((-float(np.dot(a["vec"], b["vec"])), b["uri"]) for b in tv if b["etype"] == a["etype"]))[:4]
        want |= {(a["uri"], u, round(-x, 9)) for x, u in best}
    for tile in (4096, 7):
        got = {(r.source, r.target, round(r.score, 9)) for r in knn.nearest(s, t, 4, tile=tile).collect()}
        assert got == want


def test_nearest_with_k_by_type(spark):
    k = spark.createDataFrame([("t", 2), ("other", 1)], "etype string, k int")
    got = knn.nearest(vectors(spark, 12, 1), vectors(spark, 12, 2), k).groupBy("etype").agg(F.max("rank").alias("m")).collect()
    assert {r.etype: r.m for r in got} == {"t": 2, "other": 1}


def test_token_neighbours_equal_brute_force(spark):
    rng = random.Random(4)
    rows = lambda side: [(f"{side}{i}", rng.choice("ab"), sorted({rng.choice("the of and x1 x2 x3 x4 x5 x6 x7 x8".split()) for _ in range(rng.randrange(1, 8))})) for i in range(60)]
    a, b = rows("s"), rows("t")
    kind = "uri string, etype string, tokens array<string>"
    # Sets of up to 20 words, as labels have, whose sizes are far apart.
    many = [f"w{i}" for i in range(24)]
    a += [(f"S{i}", "b", rng.sample(many, rng.choice([1, 2, 5, 9, 16, 20]))) for i in range(60)]
    b += [(f"T{i}", "b", rng.sample(many, rng.choice([1, 3, 4, 10, 18, 20]))) for i in range(60)]
    for least in (0.3, 0.5, 0.5616, 0.8, 1.0):
        got = {(r.source, r.target, round(r.score, 9)) for r in knn.token_nearest(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), 1000, least).collect()}
        want = {(s, t, round(c, 9)) for s, e, x in a for t, f, y in b if e == f and (c := len({*x} & {*y}) / (len(x) * len(y)) ** 0.5) >= least}
        assert got == want and (least == 1.0 or len(got) > 100)


@pytest.mark.parametrize("n", [40, 1000])
def test_ivf_recall(spark, n):
    """At the probes that a sample asks for, held against all sources; and with codes in place of vectors."""
    s, t = vectors(spark, n // 2, 1), vectors(spark, n, 2)
    exact = {(r.source, r.target, round(r.score, 5)) for r in knn.nearest(s, t, 3).collect()}
    cells = knn.centroids(t)
    probes, measured = knn.probes_for(s, t, 3, cells, 0.95)
    k = spark.createDataFrame([("t", 3), ("other", 3)], "etype string, k int")
    for found in (knn.ivf_nearest(s, t, k, cells, probes), knn.ivfpq_nearest(s, t, 3, cells, knn.codebooks(t, 16), probes)):
        near = {(r.source, r.target, round(r.score, 5)) for r in found.collect()}
        assert len(near) == len(exact) and len(exact & near) >= 0.9 * len(exact) and measured >= 0.95


def test_codebooks_divide_the_vector(spark):
    assert knn.codebooks(vectors(spark, 40, 1), 5).shape == (4, 40, 2)


def test_best_columns_with_ties():
    scores = np.random.default_rng(1).integers(0, 4, (50, 30)).astype(float)
    for k in (1, 2, 7, 30, 40):
        want = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        assert (knn._top(scores, min(k, 30)) == want).all()


def test_ambiguity_searches_all_targets(spark):
    """Two far clusters of close vectors: the sample's five nearest are among all of a type, not in the sample alone."""
    rows = [(f"u{i}", "t", [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(300)] + [(f"f{i}", "few", [1.0, 0.0]) for i in range(7)]
    df = spark.createDataFrame(rows, "uri string, etype string, vec array<double>")
    assert {r.etype: r.ambiguity for r in domain.ambiguity(df).collect()} == {"t": 1.0, "few": 0.0}
    turned = spark.createDataFrame([(f"u{i}", "t", np.eye(40)[i].tolist()) for i in range(40)], "uri string, etype string, vec array<double>")
    assert domain.ambiguity(turned).first().ambiguity == 0.0


def test_words_that_say_nothing_count_for_weights_but_not_for_sets(spark):
    from ontoloom.functions import similarity as S

    pairs = spark.createDataFrame([("c", "the of", "the of"), ("c", "the heart", "the lung"), ("c", "", "the")], "etype string, a string, b string")
    sets = [r[0] for r in pairs.select(S.token_set_similarity(F.col("a"), F.col("b"))).collect()]
    assert sets == [0.0, 0.0, 0.0]
    idf = resolve.idf_weights(spark.createDataFrame([("c", "the heart"), ("c", "the lung"), ("c", "")], "etype string, label string"))
    assert {r.token: r.idf for r in idf.collect()} == {"the": 1.0, "heart": pytest.approx(1.405465), "lung": pytest.approx(1.405465)}
    got = {(r.a, r.b): r.wjaccard for r in resolve.weighted_jaccard(pairs, idf).collect()}
    assert got["the of", "the of"] == 1.0 and got["the heart", "the lung"] == pytest.approx(1 / (1 + 2 * 1.405465)) and got["", "the"] == 0.0


def test_reverse_check_tests_the_discounted_score(spark):
    """By ivf a pair that the reverse search ranks low goes only if what hubs leave of its score is high."""
    names = ["alpha beta", "gamma delta", "epsilon zeta"]
    s, t = ([(f"{x}{i}", n, CLASS) for i, n in enumerate(names)] for x in "st")
    v = embed.encode(entities(spark, s).select("label"))
    rows = A.align(entities(spark, s), entities(spark, t), Settings(medical=False, search="ivf", k=1), v).collect()
    assert {(r.source, r.target) for r in rows} == {(f"s{i}", f"t{i}") for i in range(3)}


def test_greedy_is_the_sequential_walk(spark):
    rng = random.Random(5)
    rows = list({(f"s{rng.randrange(25)}", f"t{rng.randrange(25)}"): rng.randrange(6) / 5 for _ in range(250)}.items())
    df = spark.createDataFrame([(s, t, "x", v) for (s, t), v in rows], "source string, target string, etype string, score double")
    left, right, want = set(), set(), set()
    for (s, t), v in sorted(rows, key=lambda r: (-r[1], *r[0])):
        if s not in left and t not in right:
            left.add(s)
            right.add(t)
            want.add((s, t, v))
    for one_task in (10**6, 20, 0):
        assert {(r.source, r.target, r.score) for r in resolve.greedy_one_to_one(df, one_task).collect()} == want


def test_locks_need_labels_unique_on_both_sides(spark):
    s = entities(spark, [("a", "heart", "c"), ("b", "lung", "c"), ("b2", "lung", "c"), ("d", "ab", "c"), ("e", "eye", "c")])
    t = entities(spark, [("x", "heart", "c"), ("y", "lung", "c"), ("z", "ab", "c"), ("w", "eye", "p")])
    assert [(r.source, r.target, r.score) for r in resolve.exact_locks(s, t).collect()] == [("a", "x", 1.0)]
    assert {(r.source, r.target) for r in resolve.exact_locks_v1(s, t).collect()} == {("a", "x"), ("b", "y"), ("b2", "y"), ("d", "z")}


def test_reciprocity_and_hubs(spark):
    df = spark.createDataFrame([(0.9, 0.5), (0.9, 0.0), (0.9, 0.8), (0.7, 0.1)], "f double, r double")
    assert [x[0] for x in df.select(resolve.reciprocal(F.col("f"), F.col("r"), F.lit(0.8))).collect()] == [False, True, True, True]
    row = spark.range(1).select(resolve.hub_discount(F.lit(0.8), F.lit(14), F.lit(10), F.lit(10), F.lit(2)).alias("x"), resolve.hub_discount(F.lit(0.8), F.lit(14), F.lit(10), F.lit(10), F.lit(1)).alias("y")).first()
    assert row.x == pytest.approx(0.8 * 0.73) and row.y == 0.8


def test_sizes_and_thresholds():
    assert domain.ontology_size(200, 400) == 300 and domain.ontology_size(50, 400) == 112.5
    assert domain.threshold_scale(500, 1000, False) == pytest.approx(0.95 * 1.05) and domain.threshold_scale(200_000, 400_000, True) == pytest.approx(1.2744)
    # The lowest scores that published alignments have.
    assert 0.78 * domain.threshold_scale(500, 1000, False) * 0.92 == pytest.approx(0.7158, abs=1e-4)
    assert domain.name_is_medical("circular-economy", "CEON-BiOnto") and not domain.name_is_medical("conference", "cmt-edas")
    assert domain.encoder_name(100, True)[1] == 64 and "SapBERT" in domain.encoder_name(10_000, True)[0]


def test_medical_detector(spark):
    s = entities(spark, [(f"http://purl.obolibrary.org/obo/MA_{i}", f"thing {i}", "c") for i in range(3)] + [(f"http://x/{i}", "plain", "c") for i in range(40)])
    assert domain.is_medical(s, s.limit(0)) == (True, "uris")
    t = entities(spark, [(f"http://x/{i}", "heart disease" if i % 5 == 0 else "some other words", "c") for i in range(40)])
    assert domain.is_medical(t, t)[1] == "labels" and domain.is_medical(t.limit(0), t.limit(0)) == (False, "general")


def test_metrics(spark):
    pairs = lambda *x: spark.createDataFrame(list(x), "source string, target string")
    row = evaluate.prf(pairs(("a", "b"), ("c", "d"), ("e", "f")), pairs(("b", "a"), ("c", "x"))).first()
    assert (row.precision, row.recall, row.f1, row.tp) == (0.3333, 0.5, 0.4, 1)
    empty = pairs(("a", "b")).limit(0)
    assert evaluate.prf(pairs(("a", "b")), empty).first().f1 is None
    none = evaluate.prf_partial(pairs(("a", "b")), empty).first()
    assert (none.precision, none.ignored, none.system_size) == (0.0, 1, 1)
    s, g = pairs(("a", "b"), ("z", "q"), ("y", "w")), pairs(("a", "b"), ("p", "q"))
    as_coded, true = evaluate.prf_partial(s, g).first(), evaluate.prf_partial(s, g, compat=False).first()
    assert (as_coded.false_positives, as_coded.ignored) == (0, 2) and (true.false_positives, true.ignored) == (1, 1)
    typed = evaluate.prf_typed(pairs(("a", "b")).withColumn("predicate", F.lit("p")), pairs(("a", "b")).withColumn("predicate", F.lit("q"))).first()
    assert typed.tp == 0 and typed.f1 == 0.0


def test_alignment_is_one_to_one_and_finds_near_labels(spark):
    names = ["conference member", "review paper", "program committee chair", "invited speaker talk", "registration fee amount", "social event dinner"]
    s = entities(spark, [(f"s{i}", n, CLASS) for i, n in enumerate(names)])
    t = entities(spark, [(f"t{i}", n + (" item" if i % 2 else ""), CLASS) for i, n in enumerate(names)] + [("other", "nothing alike here", INDIVIDUAL)])
    for profile in (Settings(medical=False), Settings(medical=False, lev_kernel="levenshtein")):
        rows = A.align(s, t, profile).collect()
        assert {(r.source, r.target) for r in rows} == {(f"s{i}", f"t{i}") for i in range(6)}
    v = embed.encode(s.select("label").unionByName(t.select("label")))
    rows = A.align(s, t, Settings(medical=False, k=2), v).collect()
    assert {r.source for r in rows} == {r.target.replace("t", "s") for r in rows} and len(rows) == 6
    assert A.align(s.limit(0), t, Settings(medical=False)).count() == 0
    v1 = A.align_v1(s, t, vectors=v).collect()
    assert len({r.source for r in v1}) == len(v1) == len({r.target for r in v1}) >= 3


def test_cache_encodes_new_labels_only(spark, tmp_path):
    path, calls = str(tmp_path / "cache"), str(tmp_path / "calls")
    df = lambda *x: spark.createDataFrame([(y,) for y in x], "label string")

    def make():
        def encode(labels):
            with open(calls, "a") as f:
                f.writelines(x + "\n" for x in labels)
            return embed.hashed_trigrams(labels)

        return encode

    assert embed.encode_cached(df("a", "b", "b", None), path, make=make).count() == 2
    assert embed.encode_cached(df("b", "c"), path, make=make).count() == 2
    assert sorted(open(calls).read().split()) == ["a", "b", "c"]


def test_streaming_extension(spark, tmp_path):
    from ontoloom.streaming.incremental import align_stream, claims

    rows = [("s1", "heart valve", OWL + "Class", None), ("s2", "left lung", OWL + "Class", None)]
    kind = "uri string, label string, etype string, parents array<string>"
    for i, r in enumerate(rows):
        spark.createDataFrame([r], kind).write.parquet(str(tmp_path / "in" / f"p{i}"))
    stream = spark.readStream.schema(kind).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    targets = entities(spark, [("t1", "heart valve", OWL + "Class"), ("t2", "left lung", OWL + "Class")])
    align_stream(stream, targets, str(tmp_path / "out"), str(tmp_path / "cp"), Settings(medical=False)).awaitTermination(180)
    assert {(r.source, r.target) for r in claims(spark, str(tmp_path / "out")).collect()} == {("s1", "t1"), ("s2", "t2")}
