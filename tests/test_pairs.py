"""Pairs of labels in tiles: against a plain walk over all pairs, and against the Columns of single pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ontoloom.functions import pairwise as P
from ontoloom.functions import similarity as S
from ontoloom.functions import vectors as V
from ontoloom.functions.labels import words
from ontoloom.operators import pairs, resolve
from ontoloom.plans.catalogue import QUERIES


def labels_of(n: int, seed: int, said: int = 30) -> list[str]:
    rng = random.Random(seed)
    return sorted({" ".join(rng.choice(["of", "the", *(f"w{k}" for k in range(said)), "x" * rng.randint(1, 70)]) for _ in range(rng.randint(1, 12))) for _ in range(n)})


ODD = ["a", "ab", "abc", "abd", "ab c", "of the", "wo", "world of", "www", "world wide web", "a" * 62, "a" * 63, "a" * 64 + "b", "b" * 126, "ba" * 70, "abcde", "abcdf", "abcd", "un", "united nations"]


@pytest.mark.parametrize("name", ["q27_weighted_jaccard", "q29_combined_score", "q22_indel_ratio", "q24_token_set_jaccard", "q30_lexical_gate", "q20_ngram_similarity", "q23_isub", "q21_levenshtein_damped", "q31_threshold_filter"])
def test_no_pair_is_shuffled(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("MapInArrow")[0]


@pytest.mark.parametrize("tile", [2, 1024])
def test_pairs_are_all_that_share_a_rare_word_and_come_once(spark, tile):
    rows = sorted({*((etype, side, label) for etype, seed in (("x", 1), ("y", 2)) for side in (0, 1) for label in labels_of(60, seed + 10 * side)), ("x", 0, "alone here"), ("x", -1, "w1 w2")})
    df: dict = {}
    for etype, _, label in rows:
        for w in set(label.split(" ")):
            df[etype, w] = df.get((etype, w), 0) + 1
    rare = {row: set(sorted(set(row[2].split(" ")), key=lambda w, row=row: (df[row[0], w], w))[:3]) for row in rows}
    want = sorted((a[0], a[2], b[2]) for a in rows for b in rows if a[1] == 0 and b[1] == 1 and a[0] == b[0] and rare[a] & rare[b])
    told = spark.createDataFrame(rows + rows[:5], "etype string, side long, label string")
    got = pairs.scored(told, {"n": lambda s, t, i, j, w: i * 0.0}, most=3, tile=tile)
    assert sorted((r.etype, r.a, r.b) for r in got.collect()) == want


def test_kernels_equal_columns(spark):
    s, t = [*ODD, *labels_of(15, 5)], [*ODD, *labels_of(15, 6)]
    i, j = (x.ravel() for x in np.meshgrid(range(len(s)), range(len(t)), indexing="ij"))
    a, b = F.col("a"), F.col("b")
    of = lambda x: F.array_distinct(words(x))
    columns = {
        "ngram": S.ngram_similarity(a, b), "levenshtein": S.levenshtein_similarity(a, b), "indel": S.indel_similarity(a, b), "isub": S.isub_similarity(a, b),
        "token_set": S.token_set_similarity(a, b), "token_cosine": V.token_cosine(of(a), of(b)), "acronym": S.acronym_bonus(a, b),
    }
    pdf = spark.createDataFrame([(s[x], t[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)], "a string, b string").coalesce(1).select(*(c.alias(n) for n, c in columns.items())).toPandas()
    for name in columns:
        assert np.allclose(getattr(P, name)(s, t, i, j), pdf[name].to_numpy(), rtol=0, atol=1e-12), name


def test_weights_are_those_of_the_type(spark):
    rows = [("x", 0, "w1 w2 w3"), ("x", 1, "w1 w4"), ("y", 0, "w1 w2"), ("y", 1, "w1 w2 w5"), ("x", 1, "w9")]
    told = spark.createDataFrame(rows, "etype string, side long, label string")
    idf = resolve.idf_weights(told)
    got = {(r.etype, r.a, r.b): r.wjaccard for r in pairs.scored(told, {"wjaccard": P.weighted}, idf=idf.where("token <> 'w4'")).collect()}
    known = {(r.etype, r.token): r.idf for r in idf.collect()} | {("x", "w4"): 1.0}
    weight = lambda etype, *tokens: sum(known[etype, w] for w in tokens)
    assert got == pytest.approx({("x", "w1 w2 w3", "w1 w4"): weight("x", "w1") / weight("x", "w1", "w2", "w3", "w4"), ("y", "w1 w2", "w1 w2 w5"): weight("y", "w1", "w2") / weight("y", "w1", "w2", "w5")})


def test_weights_come_by_label_and_not_by_word_of_a_pair(spark):
    """Of 40 x 40 pairs of labels with 20 words each, joins see labels and pairs, but no row for a word of a pair."""
    s, t = ([f"{side}{k} " + " ".join(f"w{(k + n) % 30}" for n in range(19)) for k in range(40)] for side in "st")
    made = spark.createDataFrame([("x", a, b) for a in s for b in t], "etype string, a string, b string")
    idf = resolve.idf_weights(spark.createDataFrame([("x", label) for label in s + t], "etype string, label string"))
    found = resolve.weighted_jaccard(made, idf)
    known, got = {r.token: r.idf for r in idf.collect()}, {(r.a, r.b): r.wjaccard for r in found.collect()}
    weight = lambda some: sum(known[w] for w in some)
    assert got == pytest.approx({(a, b): weight(set(a.split()) & set(b.split())) / weight(set(a.split()) | set(b.split())) for a in s for b in t})
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_union" not in plan


def unlike(n: int, seed: int) -> list[str]:
    """Texts of few and of many letters, some of them longer than two limbs, and such that have parts of others."""
    rng = random.Random(seed)
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, most))) for letters, most in (("ab", 12), ("abc", 150), ("abcdefgh ", 300), ("a\u00e9\U0001f600", 70)) for _ in range(n)]
    return made + [x[len(x) // 3 :] + "".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) + x[: len(x) // 2] for x in made]


def test_isub_takes_many_pairs_at_once(monkeypatch):
    s, t = [*ODD, *labels_of(25, 7), *unlike(8, 1)], [*ODD, *labels_of(25, 8), *unlike(8, 1)[::2], *unlike(4, 2)]
    i, j = (x.ravel() for x in np.meshgrid(range(len(s)), range(len(t)), indexing="ij"))
    want = [S._isub(s[x], t[y], 2.5) for x, y in zip(i.tolist(), j.tolist(), strict=True)]

    def single(*_):
        raise AssertionError("a pair was taken on its own")

    with monkeypatch.context() as m:
        m.setattr(P, "_isub", single)
        assert P.isub(s, t, i, j).tolist() == want
        assert P.isub(s, t, i[:0], j[:0]).tolist() == []
        # One pair a step, and tables of a few.
        m.setattr(P, "CELLS", 1)
        m.setattr(P, "NEAR", 3)
        assert P.isub(s, t, i[::7], j[::7]).tolist() == want[::7]
    # Texts too long for a table.
    monkeypatch.setattr(P, "MOST", 200)
    assert P.isub(s, t, i, j).tolist() == want


def test_gate_asks_for_a_dear_score_only_where_no_cheaper_one_passes(spark, monkeypatch):
    s, t = [*ODD, "", *labels_of(30, 9)], [*ODD, "", *labels_of(30, 10)]
    i, j = (x.ravel() for x in np.meshgrid(range(len(s)), range(len(t)), indexing="ij"))
    weights = {w: 1.0 + len(w) % 5 for x in [*s, *t] for w in x.split(" ")}
    lists = {"sem": P.token_cosine, "lev": P.indel, "isub": P.isub, "tokset": P.token_set, "acronym": P.acronym}
    scores = {n: f(s, t, i, j) for n, f in lists.items()} | {"wjaccard": np.nan_to_num(P.weighted(s, t, i, j, weights))}
    rows = [(s[x], t[y], *(float(v[k]) for v in scores.values())) for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True))]
    told = spark.createDataFrame(rows, "a string, b string, " + ", ".join(f"{n} double" for n in scores)).coalesce(1)
    gate = resolve.lexical_gate((F.col("a") == F.col("b")) & (F.length("a") > 2), *(F.col(n) for n in ("sem", "lev", "isub", "tokset", "wjaccard", "acronym")))
    want = [r[0] for r in told.select(gate).collect()]
    assert P.passes(s, t, i, j, weights).tolist() == want and 0 < sum(want) < len(want)
    asked, isub = [], P.isub
    monkeypatch.setattr(P, "isub", lambda s, t, i, j, settings: (asked.append(len(i)), isub(s, t, i, j, settings))[1])
    P.passes(s, t, i, j, weights)
    others = (scores["sem"] >= 0.88) | (np.maximum(scores["lev"], scores["tokset"]) >= 0.45) | (scores["wjaccard"] >= 0.25) | (scores["acronym"] >= 0.8) | P.exact(s, t, i, j)
    assert asked == [int((~others).sum())]


def test_combined_scores_are_those_of_the_columns_and_leave_a_tile_as_one(spark):
    s, t = [*ODD, "", *labels_of(30, 11)], [*ODD, "", *labels_of(30, 12)]
    i, j = (x.ravel() for x in np.meshgrid(range(len(s)), range(len(t)), indexing="ij"))
    scores = [f(s, t, i, j) for f in (P.token_cosine, P.ngram, P.indel, P.isub, P.acronym)]
    rows = [(s[x], t[y], *(float(v[k]) for v in scores)) for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True))]
    told = spark.createDataFrame(rows, "a string, b string, sem double, ngram double, lev double, isub double, acronym double").coalesce(1)
    want = S.combined_score((F.col("a") == F.col("b")) & (F.length("a") > 2), *(F.col(n) for n in ("sem", "ngram", "lev", "isub")), 0.1 * F.col("acronym"))
    assert P.combined(s, t, i, j).tolist() == [r[0] for r in told.select(want).collect()]
    plan = QUERIES["q29_combined_score"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "v0#" in plan and "v1#" not in plan
