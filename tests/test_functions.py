import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ontoloom.functions import labels as L
from ontoloom.functions import similarity as S
from ontoloom.functions import vectors as V

LABELS = [("Category:Star_Wars", "star wars"), ("camelCaseLabel", "camel case label"), ("Événement-Naïf", "evenement naif"), ("HTTPServer2Go", "httpserver2 go"), ("Straße ﬁn", "strae fin"), ("a.b/c", "a b c"), ("Category:Template:x", "x"), ("Template:Category:x", "category x"), ("", ""), (None, "")]

# a, b, ngram, lev (Indel), lev (edit distance), isub
PAIRS = [
    ("organisation", "organization", 0.5385, 0.9167, 0.9167, 0.9146), ("paper", "papers", 0.7500, 0.9091, 0.5833, 0.9091), ("person", "conference member", 0, 0, 0, 0),
    ("chair", "chairman", 0.5000, 0.5385, 0.4375, 0.7692), ("ab", "abc", 0.5000, 0.3200, 0.2667, 0.8000), ("energy source", "wind energy source", 0.6875, 0.8387, 0.7222, 0.8387),
    ("process", "proces", 0.8000, 0.9231, 0.8571, 0.9231), ("author", "authors list", 0.4000, 0.6667, 0, 0.6667), ("cat", "car", 0, 0.2667, 0.2667, 0.6333), ("heart valve", "valve of heart", 0.4000, 0.4000, 0.1429, 0.7922),
]


def test_labels(spark):
    df = spark.createDataFrame([(a, b) for a, b in LABELS], "a string, b string")
    for row in df.select("a", "b", L.normalise_label(F.col("a")).alias("got")).collect():
        assert row.got == row.b, row


def test_labels_of_odd_texts_equal_the_rule(spark):
    import random
    import re
    import unicodedata

    def rule(text):
        for p in L.PREFIXES:
            text = text.removeprefix(p)
        text = re.sub("([a-z0-9])([A-Z])", r"\1 \2", text)
        return " ".join(re.sub("[^a-zA-Z0-9]", " ", unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()).lower().split()[:20])

    rng = random.Random(9)
    parts = ["aB", "é", "ﬁ", "½", "\u00a0", " ", ",", "\n", "Category:", "User:", "日本", "9", "ß", "_", "😀", "e\u0301x"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(120))) for _ in range(400)] + ["é" * 9000 + "a", "x" * 20000, "a " * 20000]
    rows = spark.createDataFrame([(t,) for t in texts], "a string").select("a", L.normalise_label(F.col("a")).alias("got"), L.normalise_label_v1(F.col("a")).alias("v1")).collect()
    for r in rows:
        assert r.got == rule(r.a)
        assert r.v1 == " ".join(re.sub("([a-z0-9])([A-Z])", r"\1 \2", r.a).replace("_", " ").replace("-", " ").lower().split()[:15])


def test_labels_are_cut_at_words_and_normalising_twice_changes_nothing(spark):
    df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(30)),), ("AbC-dEf_Ünï",)], "a string")
    once = L.normalise_label(F.col("a"))
    rows = df.select(once.alias("x"), L.normalise_label(once).alias("y"), L.normalise_label_v1(F.col("a")).alias("v1")).collect()
    assert len(rows[0].x.split()) == 20 and len(rows[0].v1.split()) == 15
    assert all(r.x == r.y for r in rows) and rows[1].v1 == "ab c d ef ünï"


def test_golden_similarities(spark):
    pairs = [(a, b, *map(float, x)) for a, b, *x in PAIRS]
    df = spark.createDataFrame(pairs + [(b, a, *x) for a, b, *x in pairs], "a string, b string, ngram double, indel double, edit double, isub double")
    a, b = F.col("a"), F.col("b")
    rows = df.select("*", S.ngram_similarity(a, b).alias("g"), S.indel_similarity(a, b).alias("i"), S.levenshtein_similarity(a, b).alias("e"), S.isub_similarity(a, b).alias("s")).collect()
    for r in rows:
        assert (r.g, r.i, r.e, r.s) == pytest.approx((r.ngram, r.indel, r.edit, r.isub), abs=6e-5), (r.a, r.b)


@settings(max_examples=300, deadline=None)
@given(st.text("abcd ", max_size=14), st.text("abcd ", max_size=14))
def test_kernels_are_symmetric_and_bounded(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        row = _next(row, c, b)
    assert S._common_length(a, b) == row[-1]
    assert S._isub(a, b, 2.5) == S._isub(b, a, 2.5) and 0 <= S._isub(a, b, 2.5) <= 1
    size, i, j = S._longest_run(a, b)
    assert a[i : i + size] == b[j : j + size]
    assert not any(a[k : k + size + 1] in b for k in range(len(a) - size))


def _next(row, c, y):
    out = [0]
    for j, d in enumerate(y):
        out.append(row[j] + 1 if c == d else max(row[j + 1], out[j]))
    return out


def test_token_sets_acronyms_and_vectors(spark):
    df = spark.createDataFrame([("united nations", "un"), ("bank of england", "be"), ("world health organisation", "who"), ("alpha", "a")], "a string, b string")
    got = [r[0] for r in df.select(S.acronym_bonus(F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, 1.0, 1.0, 0.0]
    row = spark.createDataFrame([("the cat of rome", "a cat in paris", [3.0, 4.0], [0.0, 0.0])], "a string, b string, v array<double>, z array<double>").select(
        S.token_set_similarity(F.col("a"), F.col("b")).alias("t"), V.l2_normalised(F.col("v")).alias("u"), V.l2_normalised(F.col("z")).alias("z"), V.inner_product(F.col("v"), F.col("v")).alias("p")
    ).first()
    assert row.t == pytest.approx(1 / 3) and row.u == pytest.approx([0.6, 0.8]) and row.z == [0.0, 0.0] and row.p == 25.0


def test_sql_functions(spark):
    S.register(spark)
    row = spark.sql("select isub('paper', 'papers') a, indel_ratio('ab', 'abc') b, ascii_folded('é') c").first()
    assert row.a == pytest.approx(0.9091, abs=1e-4) and row.b == pytest.approx(0.8) and row.c == "e"


def test_ngrams_of_odd_pairs_equal_the_rule(spark):
    import random

    def rule(a, b):
        a, b = a.lower(), b.lower()
        if a == b:
            return 1.0
        n = 3 if min(len(a), len(b)) >= 3 else 2
        x, y = ({t[i : i + n] for i in range(len(t) - n + 1)} for t in (a, b))
        return len(x & y) / len(x | y) if x and y else 0.0

    rng = random.Random(11)
    text = lambda: "".join(rng.choice(["a", "b", "A", " ", "é", "😀"]) for _ in range(rng.choice([0, 1, 2, 3, 4, 9, 40])))
    pairs = [(text(), text()) for _ in range(300)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", S.ngram_similarity(F.col("a"), F.col("b")).alias("g")).collect()
    assert any(0 < r.g < 1 for r in got)
    for r in got:
        assert r.g == pytest.approx(rule(r.a, r.b)), r
    nulls = spark.createDataFrame([(None, "abc"), (None, None)], "a string, b string").select(S.ngram_similarity(F.col("a"), F.col("b")).alias("g"), S.structural_similarity(F.array("a"), F.lit(None).cast("array<string>")).alias("p")).collect()
    assert [r.p for r in nulls] == [0.0, 0.0]
