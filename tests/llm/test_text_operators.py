import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ontoloom.llm import decontaminate, quality, secrets, substrings
from ontoloom.llm import text as T

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977} x{i * 7919 % 100003}" for i in range(150_000))  # about 2 MB


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("aB é\n\t1,\x0b\x85　ß€😀.", max_size=30) | st.none(), max_size=6))
def test_words_and_hashes(texts):
    import pyarrow as pa

    at, data = T.buffers(pa.array(texts, pa.string()))
    for table, pattern, low in ((T.NOT_SPACE, SPACE, False), (T.ALNUM, ALNUM, True)):
        words = T.Words(at, T.lower(data) if low else data, table)
        raw = words.data.tobytes()
        said = [raw[a:b].decode() for a, b in zip(words.start, words.end, strict=True)]
        want = [pattern.findall(lower(t or "") if low else t or "") for t in texts]
        assert said == [w for ws in want for w in ws] and words.count.tolist() == [len(w) for w in want]
        hashes = words.hashes()
        for i, a in enumerate(said):
            for j, b in enumerate(said):
                assert (a == b) == (hashes[i] == hashes[j])


# --- secrets -----------------------------------------------------------------------------------------------


def brute_spans(text):
    out = []
    for rank, (kind, pattern, group, least, base) in enumerate(secrets.RULES):
        if base:
            out += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "", re.ASCII) if len(m.group(group)) >= least]
    return [x[2] for x in sorted(out)]


SECRETS = [
    "password: hunter22 😀 token=abc Secret = 'abcdef-1'", 'é API_KEY="' + "a" * 8 + '" AKIA' + "B2" * 8 + " AKIAshort", "0123456789abcdef01234567 " + "f" * 23, None, "",
    "secret=token\"=abcdefg", "paſſword: abcdefgh toKen:xyzxyz", "AKIA" * 6, "-----BEGIN RSA PRIVATE KEY-----", LONG + " token=abcdef99",
]


def test_secrets_equal_brute_force(spark, docs, tmp_path):
    docs(SECRETS + [SECRETS[0]]).write.parquet(str(tmp_path / "documents.parquet"))
    rows = sorted(secrets.query(spark, str(tmp_path)).collect(), key=lambda r: r.doc_id)
    assert len(rows) == len(SECRETS) + 1
    for r, text in zip(rows, [*SECRETS, SECRETS[0]], strict=True):
        want = brute_spans(text)
        assert r.base_sha256 == sha(",".join(want)), r
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k) for x in want) for k in ("assign", "access", "hex"))
        assert [x for x in r.spans.split(",") if x.split(":")[0] in ("assign", "access", "hex")] == want
    assert "pem:0:31" in rows[8].spans


def test_ledger_scans_only_what_is_new(spark, docs, tmp_path):
    ledger = str(tmp_path / "ledger")
    first = docs(["token=abcdef1", "plain"]).withColumn("path", F.lit("a.txt"))
    assert secrets.scan(first, ledger).where("size(findings) > 0").count() == 1
    second = docs(["token=abcdef1", "secret=abcdef2", "token=abcdef1"]).withColumn("path", F.lit("b.txt"))
    assert secrets.scan(second, ledger).where("size(findings) > 0").count() == 3
    seen = secrets.read_ledger(spark, ledger)
    assert seen.count() == 3 == seen.select("blob").distinct().count()
    assert secrets.read_ledger(spark, str(tmp_path / "none")) is None


def test_ledger_that_has_a_blob_twice(spark, docs, tmp_path):
    """Scans that run side by side may both enter a blob."""
    ledger, texts = str(tmp_path / "ledger"), ["token=abcdef1", "plain", "token=abcdef1"]
    secrets.scan_unseen(docs(texts), ledger)
    spark.read.parquet(ledger).write.parquet(str(tmp_path / "copy"))
    spark.read.parquet(str(tmp_path / "copy")).write.mode("append").parquet(ledger)
    assert secrets.read_ledger(spark, ledger).count() == 4
    rows = secrets.scan(docs(texts), ledger).collect()
    assert sorted((r.doc_id, len(r.findings)) for r in rows) == [(0, 1), (1, 0), (2, 1)]
    assert sorted(r.text for r in secrets.redact(docs(texts), ledger=ledger).collect()) == ["[REDACTED]", "[REDACTED]", "plain"]
    assert secrets.read_ledger(spark, ledger).count() == 4


def test_ledger_of_other_rules_counts_for_nothing(spark, docs, tmp_path):
    ledger = str(tmp_path / "ledger")
    secrets.scan_unseen(docs(["token=abcdef1"]), ledger)
    old = spark.read.parquet(ledger).withColumn("rule_version", F.lit("old")).withColumn("findings", F.array().cast(secrets.FINDINGS))
    old.write.parquet(str(tmp_path / "old"))
    assert secrets.scan(docs(["token=abcdef1"]), str(tmp_path / "old")).first().findings[0].kind == "assign"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["eyJ", "eyJeyJ", "abcdefgh", "a", "abcdefghijk", ".", "..", "-", "_", " ", "\n", "é"]), max_size=14).map("".join))
def test_tokens_are_found_as_by_their_pattern(text):
    pattern = next(r[1] for r in secrets.RULES if r[0] == "jwt")
    found = [(a, b) for a, _, b, k in secrets.find(text) if k == "jwt"]
    assert found == [(m.start(), m.end()) for m in re.finditer(pattern, text)]


def test_redaction_keeps_columns_and_the_rest_of_the_text(docs):
    df = docs(SECRETS[:5], {"_name": F.lit("x"), "_found": F.lit(1), "findings": F.lit("mine")})
    out = secrets.redact(df)
    assert out.columns == df.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[0].text == "[REDACTED] 😀 token=abc [REDACTED]'" and rows[0].n_chars == len(rows[0].text) and rows[0].findings == "mine"
    assert rows[3].text is None and rows[4].text == "" and rows[1]._name == "x"
    assert secrets.redact(df.limit(0)).count() == 0


# --- decontamination -----------------------------------------------------------------------------------------


def brute_hits(texts, items, window=10):
    out = []
    for text in texts:
        words = ALNUM.findall(lower(text or ""))
        hit, found = set(), set()
        for item, said in items:
            w = ALNUM.findall(lower(said or ""))
            n = min(window, len(w))
            for i in range(len(w) - n + 1 if n else 0):
                for j in range(len(words) - n + 1):
                    if words[j : j + n] == w[i : i + n]:
                        hit |= set(range(j, j + n))
                        found.add(item)
        out.append((len(words), len(hit), sorted(map(str, found))))
    return out


def test_contamination_equals_brute_force(spark, docs):
    rng = random.Random(3)
    word = lambda: rng.choice("ab cd ef gh ij kl éé".split())
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([12, 10, 3, 1, 25])] + [(7, None), (8, "..."), (9, "ab cd")]
    texts = [" ".join(word() for _ in range(n)) for n in (0, 1, 2, 9, 10, 40, 80)] + [None, "", items[4][1].upper().replace(" ", ", "), "x " + items[0][1] + " y", LONG + " " + items[1][1]]
    texts += texts[5:6]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumns({"key": F.lit(1), "words": F.lit("w")})
    got = decontaminate.contaminated(docs(texts, {"uid": F.lit(1), "places": F.lit(2)}), bench).orderBy("doc_id").collect()
    short = [t if t is None or len(t) < 10**6 else None for t in texts]
    for r, want, text in zip(got, brute_hits(short, items), texts, strict=True):
        if text is None or len(text) < 10**6:
            assert (r.n_words, r.n_hit, r["items"]) == want
        else:
            assert "1" in r["items"] and r.n_hit >= 10
    same = docs([(1, "ab"), (1, ""), (1, None), (1, "ab")])
    one = spark.createDataFrame([(3, "ab")], "item_id long, text string")
    assert sorted((r.n_words, r.n_hit) for r in decontaminate.contaminated(same.coalesce(1), one).collect()) == [(0, 0), (0, 0), (1, 1), (1, 1)]
    empty = bench.limit(0)
    assert decontaminate.contaminated(docs(texts[:3]), empty).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.contaminated(docs(texts[:3]).limit(0), bench).count() == 0
    kept = decontaminate.keep_clean(docs(texts[:7], {"_gone": F.lit(1)}), spark.createDataFrame([(1, "ab cd")], "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {i for i, t in enumerate(texts[:7]) if "ab cd" not in t} and kept.columns[-1] == "_gone"


def test_keep_clean_judges_each_row_by_its_own_words(spark, docs):
    rows = [(1, "x ab cd y"), (1, "clean one"), (1, None), (1, ""), (None, "ab cd"), (None, "clean too"), (None, None), (2, "ab cd"), (2, "AB, cd!"), (2, "cd ab"), (3, "clean one"), (3, "clean one")]
    kept = decontaminate.keep_clean(docs(rows, {"_uid": F.lit(1), "_gone_uid": F.lit(2)}), spark.createDataFrame([(1, "ab cd")], "item_id long, text string"))
    want = [r for r in rows if r not in [rows[0], rows[4], rows[7], rows[8]]]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(want, key=repr) and kept.columns[-2:] == ["_uid", "_gone_uid"]


# --- substrings -----------------------------------------------------------------------------------------------


def brute_substrings(rows):
    least = {}
    for i, text in rows:
        w = SPACE.findall(text or "")
        for j in range(len(w) - 12):
            key = tuple(w[j : j + 13])
            least[key] = min(least.get(key, 1 << 70), 1 << 63 if i is None else i)
    out = []
    for i, text in rows:
        w = SPACE.findall(text or "")
        gone = set()
        for j in range(len(w) - 12):
            if least[tuple(w[j : j + 13])] < (1 << 63 if i is None else i):
                gone |= set(range(j, j + 13))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("blocks", [1, 5])
def test_substrings_equal_brute_force(docs, blocks):
    rng = random.Random(blocks)
    passage = [" ".join(f"p{k}-{i}" for i in range(n)) for k, n in enumerate([12, 13, 14, 30, 60])]
    filler = lambda n: " ".join(f"f{rng.randrange(10**9)}" for _ in range(n))
    rows = [(i, "  ".join(x for _ in range(3) for x in (filler(rng.randrange(9)), rng.choice(passage)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, " \t "), (63, "a " * 40), (64, "a " * 40), (3, rows[3][1]), (None, passage[4]), (None, "n " + passage[4]), (70, LONG), (71, LONG[100:5000])]
    df = docs(rows, {"block": F.lit(1), "range": F.lit(2), "n_words": F.lit(9)})
    got = sorted((tuple(r) for r in substrings.dedup(df, blocks).collect()), key=repr)
    assert got == brute_substrings(rows)
    assert substrings.dedup(df.limit(0)).count() == 0


def test_substrings_give_kept_texts_and_removed_runs(docs):
    p, q, é = ([f"{k}{i}" for i in range(20)] for k in ("p", "q", "é"))
    texts = [[*p], [*q], [*é], ["a", *p, "b", *q], [*p], [*p[:15]], [*é, "c", "é0"], [], ["d"]]
    df = docs([(i, "  ".join(x)) for i, x in enumerate(texts)] + [(9, None)])
    want = {0: [], 1: [], 2: [], 3: [(1, 21), (22, 42)], 4: [(0, 20)], 5: [(0, 15)], 6: [(0, 20)], 7: [], 8: [], 9: []}
    for blocks in (1, 5):
        rows = {r.doc_id: r for r in substrings.kept_texts(df, blocks).collect()}
        assert {i: [tuple(x) for x in r.removed] for i, r in rows.items()} == want
        for i, r in rows.items():
            x = [*texts, []][i]
            assert r.n_words == len(x) and r.kept == " ".join(w for j, w in enumerate(x) if not any(a <= j < b for a, b in want[i]))
    assert substrings.kept_texts(df.limit(0)).count() == 0


def test_ranges_are_sorted_runs_and_none_is_empty():
    hashes = np.unique(np.random.default_rng(1).integers(0, 1 << 64, 5000, np.uint64))
    for n in (1, 3, 128, 10**6, 1 << 31):
        has, edges = substrings._ranges(hashes, n)
        assert (np.diff(has) > 0).all() and 0 <= has[0] and has[-1] < n and (np.diff(edges) > 0).all() and edges[0] == 0 and edges[-1] == len(hashes)
    has, edges = substrings._ranges(hashes[:0], 128)
    assert len(has) == 0 and edges.tolist() == [0]


def test_cover_has_every_difference():
    for d in range(substrings.PERIOD):
        assert any((a + d) % substrings.PERIOD in substrings.COVER for a in substrings.COVER)


# --- quality ----------------------------------------------------------------------------------------------------


def brute_quality(text):
    text = text or ""
    w = SPACE.findall(text)
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    windows = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
    from collections import Counter

    seen, cover = Counter(windows), set()
    for j, x in enumerate(windows):
        if seen[x] > 1:
            cover |= set(range(j, j + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w)


PROSE = "The heart valve opens when pressure rises. It closes again as the pressure falls, and so on."
TEXTS = [PROSE, None, "", "\n\n", "a b c d e a b c d e a b c d e a b", "x\nx\n y\n y\nx", PROSE + "\n" + PROSE, "#*$%&|<> é 😀", LONG, "Home | News | About | Contact | Sitemap | Help | Login | Search | Shop | Jobs | Press",
         PROSE + "\nHome | News | About | Contact\nAll rights reserved.", "BUY!! NOW!! " * 8, "word%%% other$$$ thing### that*** one&&& two%%% six*** ten### end$$$ new%%% old***", "one one one one two two two two three three three three four four four four"]


def test_quality_counts_equal_brute_force(spark, docs, tmp_path):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    got = quality.rate(docs(texts, {"n_words": F.lit(1)})).orderBy("doc_id").collect()
    for r, text in zip(got, texts, strict=True):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(text)
        assert not (r.kept and r.base_failed)


def test_quality_verdicts(docs):
    kept = {r.doc_id: r.kept for r in quality.rate(docs(TEXTS)).collect()}
    assert kept[0] and kept[8] and kept[10] and not any(kept[i] for i in (1, 2, 9, 11, 12, 13))
    out = quality.clean(docs(TEXTS, {"kept": F.lit("x")})).collect()
    assert {r.doc_id for r in out} == {i for i, k in kept.items() if k}
    row = next(r for r in out if r.doc_id == 10)
    assert row.text == PROSE and row.n_chars == len(PROSE) and row.kept == "x"
    assert quality.clean(docs(TEXTS).limit(0)).count() == 0


def test_lines_of_each_kind(docs):
    """Lines that must fail, each on its own between two that pass."""
    bad = [
        "Home | News | About | Contact", "Start > Shoes > Boots > Winter", "Accueil » Produits » Hiver » Bottes", "Inicio · Noticias · Ayuda · Contacto", "See https://a.example/x www.b.example/y", "word%%% other$$$ ###", "NOW!! BUY!! HERE!!",
        "next page", "Alle Rechte vorbehalten, auch die der Übersetzung.", "Tous droits réservés par les auteurs.", "so so so so so so.", "Sign up for our newsletter today, please.",
    ]
    good = ["Either / or, as they say; both is fine.", "One link, https://a.example/x, in a sentence that goes on.", "He said > and meant it, or so it seems.", "Privacy and a policy are two things."]
    texts = [f"{PROSE}\n{x}\nNothing more was said about that by anyone who had been there at the time, as far as is known." for x in bad + good]
    out = {r.doc_id: r.text.split("\n") for r in quality.clean(docs(texts)).collect()}
    assert [len(out[i]) for i in range(len(texts))] == [2] * len(bad) + [3] * len(good)


def test_quality_of_neighbouring_rows(docs):
    """A row's verdict is its own: no phrase reaches over the end of a text, not even after empty ones."""
    texts = ["We take care of all that you tell us in our privacy", "", " policy and more words that stand on the same line, so it goes.", None, "the end of it all is that lorem", " ipsum is what remains when words are gone for good."]
    want = [(r.n_kept_words, r.kept) for t in texts for r in quality.rate(docs([t])).collect()]
    assert [(r.n_kept_words, r.kept) for r in quality.rate(docs(texts).coalesce(1)).orderBy("doc_id").collect()] == want


def test_quality_agrees_with_labels(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality is not null").select("doc_id", "quality").distinct()
    rows = quality.rate(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(labels, "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    assert sum(r.kept for r in rows if r.quality == 0) <= 0.05 * sum(r.quality == 0 for r in rows)
