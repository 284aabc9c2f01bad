import hashlib
import io
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ontoloom.llm import chat, langid, packing, simhash, urlfilter, warc

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977} x{i * 7919 % 100003}" for i in range(150_000))


# --- WARC -----------------------------------------------------------------------------------------------


PAGES = [(1, "http://a/é\r\nX: y", "x" * 1000), (2, None, "x" * 1000), (3, "u", "y" * 999), (4, "u", "y" * 999), (5, "u", None), (6, "", "é" * 600), (7, "u", "é" * 600), (7, "u", "é" * 600), (None, "u", "z" * 2000), (9, "u", "q" * 3_000_000), (10, "u", "\r\n\r\nWARC/1.1\r\n")]


def test_warc_round_trip(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"_digest": F.lit(1), "payload": F.lit("p"), "refers_to": F.lit(3)})
    path = str(tmp_path / "w")
    warc.archive(df.repartition(3), path)
    rows = warc.read(spark, path).collect()
    assert len(rows) == len(PAGES)
    for r in rows:
        html = next((h or "" for i, _, h in PAGES if i == r.page_id)).encode()
        assert r.payload_bytes == len(html) and r.payload_digest == hashlib.sha1(html).hexdigest()
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == html
    assert {(r.page_id, r.record_type, r.refers_to) for r in rows if r.record_type == "revisit"} == {(1, "revisit", 2), (6, "revisit", 7)}
    # A second write adds to the first; records have ids of their own, also where pages repeat.
    more = spark.createDataFrame([(11, "v", "w" * 50), (1, "v", "other")], "page_id long, url string, html string")
    warc.archive(more, path)
    again = warc.read(spark, path).collect()
    assert len(again) == len(PAGES) + 2 and {11, 1, 10} <= {r.page_id for r in again}
    ids = []
    for name in (tmp_path / "w").glob("*.warc.gz"):
        with open(name, "rb") as stream:
            ids += [warc.parse(x)["WARC-Record-ID"] for x in warc.members(stream)]
    assert len(set(ids)) == len(ids) == len(again)
    warc.archive(more, path, overwrite=True)
    assert sorted(r.page_id for r in warc.read(spark, path).collect()) == [1, 11] and len(list((tmp_path / "w").glob("*.warc.gz"))) <= 2
    empty = str(tmp_path / "e")
    warc.archive(df.limit(0), empty)
    assert warc.read(spark, empty).count() == 0


def test_warc_finds_damage():
    good = warc.member(1, "u", b"hello" * 100, None)
    assert [warc.parse(x)["payload"] for x in warc.members(io.BytesIO(good + good))] == [b"hello" * 100] * 2
    with pytest.raises(EOFError):
        list(warc.members(io.BytesIO(good + good[:-9])))
    raw = zlib.decompress(good, 31)
    for bad in (raw.replace(b"hello", b"hallo", 1), raw.replace(b"Content-Length: 5", b"Content-Length: 4", 1), b"X" + raw):
        with pytest.raises((ValueError, KeyError)):
            warc.parse(bad)


# --- chat -------------------------------------------------------------------------------------------------


def test_templates():
    render = lambda source, **names: chat.compile_template(source)(**names)[0]
    assert render("{{ 'a' ~ (1 + 2) }}{% if 1 < 2 and not false %}y{% else %}n{% endif %}") == "a3y"
    assert render("{% for m in ms %}{{ loop.index }}{{ m.a|upper }}{% if not loop.last %},{% endif %}{% endfor %}", ms=[{"a": "x"}, {"a": "y"}]) == "1X,2Y"
    assert render("a {{- ' b ' -}} c{# no #}{% set z = 3 %}{{ z }}{{ missing }}") == "a b c3"
    assert render("{{ xs[0] }}{{ xs[5] }}{{ 'k' in d }}", xs=["p"], d={"k": 1}) == "pTrue"
    text, marked = chat.compile_template("u{% generation %}{{ t }}{% endgeneration %}v")(t="abc")
    assert (text, marked) == ("uabcv", [(1, 4)])
    assert chat.fold_body(chat.parse("{% if 1 == 1 %}a{{ 'b' }}{% else %}{{ x }}{% endif %}c")) == [("data", "abc")]
    for bad in ("{{ x.__class__ }}", "{{ f(1) }}", "{% import os %}", "{% if x %}", "{% endfor %}", "{{ 'a' | exec }}", "{{ 1 + }}", "{% else %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    with pytest.raises(chat.TemplateError):
        render("{{ x.a }}", x=object())


def test_escapes_are_reversible():
    rng = random.Random(1)
    pieces = [*chat.CONTROLS, "\\", "\\\\", "<", ">", "[", "/", "é", "\n", "INST]", "s>"]
    for _ in range(2000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(8)))
        made = chat.escape(text)
        assert chat.unescape(made) == text and not any(c in made for c in chat.CONTROLS)


def test_conversations(spark):
    rows = [(1, 1, "assistant", "</s>b\\"), (1, 0, "user", "a[INST]"), (2, 0, None, None), (2, 0, "tool", "<|end|>"), (None, 0, "user", "n"), (3, None, "system", "first"), (3, 0, "assistant", LONG), (3, 1, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r.conv_id: r for r in chat.render_conversations(df).collect()}
    assert chat.turns(got[1].formatted) == [("user", "a[INST]"), ("assistant", "</s>b\\")]
    assert sorted(chat.turns(got[2].formatted)) == [("", ""), ("tool", "<|end|>")] and chat.turns(got[None].formatted) == [("user", "n")]
    assert [t for _, t in chat.turns(got[3].formatted)] == ["first", LONG, ""]
    assert ["".join(chat.unescape(g.formatted[a:b]) for a, b in g.marked) for g in (got[1], got[3])] == ["</s>b\\", LONG]
    assert chat.render_conversations(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="no turn"):
        chat.turns("[INST]x")


# --- SimHash ------------------------------------------------------------------------------------------------


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    parent = {i: i for i in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in prints}


def test_simhash_equals_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "One"), (10**6 + 3, "one two"), (10**6 + 4, "ÀA bB"), (10**6 + 5, LONG)], "doc_id long, text string")
    docs.select("doc_id", "text").unionByName(extra).withColumns({"print": F.lit(1), "low": F.lit(2), "path": F.lit(3)}).write.parquet(str(tmp_path / "documents.parquet"))
    rows = simhash.query(spark, str(tmp_path)).collect()
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").unionByName(extra).collect()}
    prints = {i: brute_print(t) for i, t in texts.items()}
    whose = brute_components(prints)
    assert len(rows) == len(texts)
    for r in rows:
        assert (int(r.fingerprint, 16), r.component_id) == (prints[r.doc_id], whose[r.doc_id]) and len(r.fingerprint) == 16
    one = spark.createDataFrame([("a b c",)], "t string").select(F.xxhash64("t")).first()[0]
    assert brute_print("A b c") == one % (1 << 64)


def signed(p):
    return p - (1 << 64) if p >> 63 else p


def linked(spark, prints):
    """The smallest fingerprint of each one's component."""
    df = spark.createDataFrame([(signed(p),) for p in prints], "print long")
    found = {r.vertex: r.component for r in simhash.components(simhash.pairs(df)).collect()}
    return {signed(p): found.get(signed(p), signed(p)) for p in prints}


def test_keys_have_every_pair_within_two_bits():
    masks = [[int(m) & (1 << 64) - 1 for m in level] for level in simhash.fixed_masks()]
    assert [(len(x), {m.bit_count() for m in x}) for x in masks] == [(6, {32}), (36, {48}), (216, {56})]
    rng = random.Random(5)
    for _ in range(300):
        bits = sum(1 << rng.randrange(64) for _ in range(rng.randrange(3)))
        paths = [range(6)]
        for level in range(3):
            met = [p for p in paths[level] if masks[level][p] & bits == 0]
            assert met and (not level or all(masks[level][p] & masks[level - 1][p // 6] == masks[level - 1][p // 6] for p in met))
            paths.append([p * 6 + k for p in met for k in range(6)])


def test_a_hundred_thousand_prints_that_share_a_key(spark):
    """A key of 10**5 prints is split twice; what is linked is what single bits and pairs of bits say."""
    rng = np.random.default_rng(3)
    low = rng.choice(1 << 32, 100_000, replace=False).astype(np.uint64)
    prints = low | np.uint64(0xABCD1234 << 32)
    df = spark.createDataFrame(pd.DataFrame({"print": prints.view(np.int64)}))
    found = simhash.components(simhash.pairs(df)).toPandas()
    where, parent = {int(p): i for i, p in enumerate(low)}, list(range(len(low)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    flips = [1 << i for i in range(32)] + [1 << i | 1 << j for i in range(32) for j in range(i)]
    for f in flips:
        for i in np.flatnonzero(np.isin(low ^ np.uint64(f), low)).tolist():
            a, b = root(i), root(where[int(low[i]) ^ f])
            parent[a] = b
    groups = {}
    for i in range(len(low)):
        groups.setdefault(root(i), []).append(int(prints[i : i + 1].view(np.int64)[0]))
    want = {p: min(g) for g in groups.values() if len(g) > 1 for p in g if p != min(g)}
    assert len(want) > 500 and dict(zip(found.vertex.tolist(), found.component.tolist(), strict=True)) == want


def test_every_print_of_a_dense_block(spark):
    """All 2**12 prints of twelve bits, spread over all quarters, and some far from any: keys of thousands, one component."""
    rng, bits = random.Random(11), [0, 5, 13, 16, 20, 31, 32, 40, 47, 48, 55, 63]
    base = rng.getrandbits(64)
    prints = {base ^ sum(1 << b for i, b in enumerate(bits) if x >> i & 1) for x in range(1 << 12)}
    far = {rng.getrandbits(64) for _ in range(50)}
    got = linked(spark, prints | far)
    assert {got[signed(p)] for p in prints} == {min(map(signed, prints))} and all(got[signed(p)] == signed(p) for p in far)


def test_links_and_components_of_clusters(spark):
    rng = random.Random(7)
    prints = set()
    for _ in range(12):
        center = rng.getrandbits(64)
        for _ in range(40):
            x = center
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    assert linked(spark, prints) == brute_components({signed(p): p for p in prints})
    chain = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(101, 100)], "u long, v long")
    assert {r.vertex: r.component for r in simhash.components(chain).collect()} == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_near_duplicates_without_ids_or_rows(spark):
    df = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, "q r s t u"), (9, "x y z")], "doc_id long, text string").withColumn("_gone", F.lit(0))
    rows = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()]
    assert sorted(rows, key=repr) == sorted([(None, 4), (5, 4), (4, 4), (4, 4), (None, None), (9, 9)], key=repr)
    assert sorted((r.doc_id for r in simhash.keep_one(df).collect()), key=repr) == sorted([4, None, 9], key=repr)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert simhash.keep_one(df.limit(0)).count() == 0 and simhash.keep_one(df).columns == df.columns
    # Rows that share an id are judged by their own texts; of rows without ids that repeat one stays.
    df = spark.createDataFrame([(2, "a b c d"), (4, "a b c d"), (4, "q r s t u"), (None, "x y z"), (None, "x y z")], "doc_id long, text string").withColumns({"_row": F.lit(1), "_print": F.lit(2), "_stay": F.lit(3)})
    assert sorted(((r.doc_id, r.text) for r in simhash.keep_one(df).collect()), key=repr) == sorted([(2, "a b c d"), (4, "q r s t u"), (None, "x y z")], key=repr)


def test_near_duplicates_of_documents_that_share_an_id(spark):
    far = [(4, "a b c d"), (4, "q r s t u")]
    df = spark.createDataFrame(far, "doc_id long, text string")
    assert sorted(tuple(r) for r in simhash.keep_one(df).collect()) == far
    # One of them has a copy with a smaller id: the other keeps its own component, and a row in it.
    for one, other in (far, far[::-1]):
        rows = [*far, (2, one[1]), (None, "x y z"), (None, "k l m")]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        want = [(2, one[1]), other, (None, "x y z"), (None, "k l m")]
        assert sorted((tuple(r) for r in simhash.keep_one(df).collect()), key=repr) == sorted(want, key=repr)
        assert sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=repr) == sorted([(4, 2), (4, 4), (2, 2), (None, None), (None, None)], key=repr)


# --- packing ------------------------------------------------------------------------------------------------


def test_packing_is_whole_and_gapless(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()][:80]
    texts += [None, "", "<|endoftext|> x <|endoftext|>", "  é\n\n😀 'll", LONG[:300_000], texts[0]]
    df = docs(texts, {"part": F.lit(1), "n": F.lit(2), "ids": F.lit(3)}).repartition(3)
    rows = packing.pack(df).collect()
    ids = {i: [*full.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    at, filled = {i: 0 for i in ids}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(piece.tobytes()) and r.continues == (r.start > 0)
        at[r.doc_id] += r.length
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert at == {i: len(x) for i, x in ids.items()}
    for seq, pieces in filled.items():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
        assert sum(n for _, n in pieces) == 2048 or seq == max(filled)
    assert sorted(filled) == list(range(len(filled))) and packing.pack(df.limit(0)).count() == 0


def test_packing_gives_the_ids_of_its_sequences(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["one two three", None, LONG[:300_000], "", "four five"]
    df = docs(texts)
    filled: dict = {}
    for r in packing.pack(df, length=512).collect():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length
        filled.setdefault(r.sequence_id, []).append((r.offset, r.doc_id, r.start, ids))
    docs_ids: dict = {}
    stream = []
    for seq in sorted(filled):
        for _, i, start, ids in sorted(filled[seq]):
            assert start == len(docs_ids.setdefault(i, []))
            docs_ids[i] += ids
            stream += ids
    assert docs_ids == {i: [*full.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    assert all(sum(len(x[3]) for x in filled[seq]) == 512 for seq in filled if seq != max(filled)) and len(stream) == sum(map(len, docs_ids.values()))


# --- urls ----------------------------------------------------------------------------------------------------


def brute_judge(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n]), rest[n:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[1] if best else "allow"


def test_urls_equal_brute_force(spark):
    urls = [None, "", "no scheme", "http://", "http://Example.ORG/es/1", "https://a.b.example.org/en/12", "http://example.org/en/2", "http://org/", "http://xorg/", "http://x.org", "http://a.com/fr/", "http://a.com/de/x?y",
            "http://u@a.com:80/de/", "ftp://a.com/fr/#z", "a://b://c.org/", "http://.org/", "http://a..org/x", "http://é.org/é\n/x", "HTTP://X.com?de", "http://example.org/es/1"]
    df = spark.createDataFrame([(None if i == 3 else i % 17, u) for i, u in enumerate(urls)], "page_id long, url string").withColumns({"host": F.lit(1), "_key": F.lit(2), "rule": F.lit(3)})
    rules = [*urlfilter.RULES, ("block", "a.com", "/fr/"), ("allow", "a.com", "/fr/")]
    got = sorted((tuple(r) for r in urlfilter.judge(df, urlfilter.rules_frame(spark, rules)).collect()), key=repr)
    assert got == sorted(((None if i == 3 else i % 17, *brute_judge(u, rules)) for i, u in enumerate(urls)), key=repr)
    assert urlfilter.judge(df, urlfilter.rules_frame(spark, [])).where("verdict = 'allow' and rule is null").count() == len(urls)
    assert urlfilter.judge(df.limit(0), urlfilter.rules_frame(spark)).count() == 0


# --- languages ---------------------------------------------------------------------------------------------------


def test_languages_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("half", F.pmod(F.hash("doc_id"), F.lit(2)))
    model = langid.fit(docs.where("half = 0"))
    pages = docs.where("half = 1 and length(text) > 40").select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"), "lang")
    got = langid.identify(pages, model).join(pages.select("page_id", F.col("lang").alias("true")), "page_id")
    assert got.agg(F.avg((F.col("lang") == F.col("true")).cast("double"))).first()[0] >= 0.95


def brute_fused(rows, langs):
    """(language, confidence) for rows of host, language by text, declared language and scores."""
    label = lambda h: h.split(":")[0].rsplit(".", 1)[-1]
    suffix = lambda h: label(h) if re.fullmatch("[a-z]{2,3}", label(h)) else "other"
    n = lambda test: [sum(test(r) and r[1] == x for r in rows) for x in langs]
    every, k = n(lambda r: True), len(langs)
    wide = [(x + 1) / (sum(every) + k) for x in every]
    out = []
    for host, said, declared, scores in rows:
        s, h = n(lambda r, host=host: suffix(r[0]) == suffix(host)), n(lambda r, host=host: r[0] == host)
        mid = [(x + langid.SUFFIX_WEIGHT * w) / (sum(s) + langid.SUFFIX_WEIGHT) for x, w in zip(s, wide, strict=True)]
        h = [x - (said == lang) for x, lang in zip(h, langs, strict=True)]
        prior = [(x + langid.HOST_WEIGHT * m) / (sum(h) + langid.HOST_WEIGHT) for x, m in zip(h, mid, strict=True)]
        told = [1.0] * k
        d = n(lambda r, declared=declared: r[2] == declared)
        if declared is not None and sum(d):
            of = n(lambda r: r[2] is not None)
            told = [(a + langid.DECLARED_WEIGHT * (sum(d) + 0.5) / (sum(of) + 1)) / (b + langid.DECLARED_WEIGHT) for a, b in zip(d, of, strict=True)]
        log = np.array([float(np.log(p) + x + np.log(t)) for p, x, t in zip(prior, scores, told, strict=True)])
        out.append((langs[int(np.argmax(log))], float(1 / np.exp(log - log.max()).sum())))
    return out


def test_fusion_equals_brute_force(spark):
    rng, langs = random.Random(2), ["de", "en", "fr"]
    rows = [(i, rng.choice(["a.fr", "b.de", "c.com", "", "x.museum", "d.de:80"]), rng.choice([*langs, None]), rng.choice([*langs, "xx", None]), [rng.uniform(-9, 0) for _ in langs]) for i in range(80)]
    df = spark.createDataFrame(rows, "page_id long, host string, text_lang string, declared string, scores array<double>")
    got = {r.page_id: r for r in langid.fused(df, langs).collect()}
    for row, (lang, share) in zip(rows, brute_fused([r[1:] for r in rows], langs), strict=True):
        assert got[row[0]].lang == lang and got[row[0]].confidence == pytest.approx(share, abs=2e-6)


MARKUP = re.compile(r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>|&[#\w]+;")
DECLARED = re.compile(r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})(?![a-z])""")
MARKS = ["<script", "<script ", "</script>", "<style>", "</STYLE>", "<!--", "-->", "<", "</p>", ">", "&amp;", "&", "x", "<html", " lang=", '"de"', "fr", "\n", " ", "lang", "=", "en-gb", "é"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(MARKS), max_size=14).map("".join))
def test_pages_are_read_as_by_patterns(html):
    found = DECLARED.search(html)
    assert langid.read_page(html) == (MARKUP.sub(" ", html), found[1].lower() if found else None)


def brute_trigrams(text):
    """Numbers of the trigrams of a text: bytes other than a-z and those beyond ASCII are blanks, and two blanks are none."""
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    low = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in low)
    codes = [(a << 16 | b << 8 | c) for a, b, c in zip(low, low[1:], low[2:], strict=False) if not (a == b == 32 or b == c == 32)]
    return [(code * 0x9E3779B97F4A7C15 % (1 << 64)) >> 49 for code in codes]


def test_whole_language_query_equals_brute_force(spark, tmp_path):
    """Fit, reading, trigram scores, priors and fusion in plain Python; few enough documents for all to be in the sample."""
    for name in ("documents", "pages"):
        rows = spark.read.parquet(f"{SF}/{name}.parquet")
        if name == "pages":
            odd = [(10**6, None, None), (10**6 + 1, "http://a.fr/", ""), (10**6 + 2, "http://a.fr/x", "<html lang='fr'><p>Le chat est dans la maison avec les autres"), (10**6 + 2, "http://a.fr/x", "<p>&amp;</p>"), (None, "no scheme", "the cat and the dog in the house")]
            rows = rows.unionByName(spark.createDataFrame(odd, "page_id long, url string, html string"))
        rows.write.parquet(str(tmp_path / f"{name}.parquet"))
    docs, pages = (spark.read.parquet(str(tmp_path / f"{n}.parquet")).collect() for n in ("documents", "pages"))
    langs = sorted({r.lang for r in docs})
    table = {x: np.full(1 << 15, 0.5) for x in langs}
    for r in docs:
        for t in brute_trigrams(r.text or ""):
            table[r.lang][t] += 1
    table = {x: np.log(v / v.sum()) for x, v in table.items()}
    read = []
    for r in pages:
        html = r.html or ""
        found, t = DECLARED.search(html), brute_trigrams(MARKUP.sub(" ", html))
        scores = [table[x][t].sum() * min(len(t), 40) / max(1, len(t)) for x in langs]
        host = brute_judge(r.url, [])[0]
        read.append((host, langs[int(np.argmax(scores))] if t else None, found[1].lower() if found else None, scores))
    want = sorted(((r.page_id, x[1], x[2], lang, round(p, 4)) for r, x, (lang, p) in zip(pages, read, brute_fused(read, langs), strict=True)), key=repr)
    got = sorted(((r.page_id, r.text_lang, r.declared, r.lang, round(r.confidence, 4)) for r in langid.query(spark, str(tmp_path)).collect()), key=repr)
    assert [x[:4] for x in got] == [x[:4] for x in want] and [x[4] for x in got] == pytest.approx([x[4] for x in want], abs=2e-4)


def test_languages_of_pages_whose_address_names_them(spark):
    """The path's first part is the page's language; nothing that the operator reads. Declarations and hosts only help."""
    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet").withColumn("true", F.regexp_extract("url", "://[^/]+/([a-z]{2})/", 1)).where(F.col("true") != "")
    model = langid.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    bare = pages.select("page_id", F.lit(None).cast("string").alias("url"), F.regexp_replace("html", "(?i)<html[^>]*>", "<html>").alias("html"))
    share = lambda got: got.join(pages.select("page_id", "true"), "page_id").agg(F.avg((F.col("lang") == F.col("true")).cast("double"))).first()[0]
    alone, whole = share(langid.identify(bare, model)), share(langid.identify(pages.select("page_id", "url", "html"), model))
    assert pages.count() > 200 and whole >= 0.9 and whole >= alone - 0.01


def test_fit_draws_every_language(spark):
    """One language of a thousand rows among a million would not be in a plain sample of a few."""
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4000 == 7, "nl").otherwise("en").alias("lang"), F.when(F.col("id") % 4000 == 7, "het is een heel mooi huis").otherwise("it is a very nice house").alias("text"))
    model = langid.fit(rows, max_rows=40)
    assert model.langs == ["en", "nl"]
    got = langid.identify(spark.createDataFrame([(1, None, "een mooi huis"), (2, None, "a nice house")], "page_id long, url string, html string"), model)
    assert {r.page_id: r.text_lang for r in got.collect()} == {1: "nl", 2: "en"}


def test_pages_with_nothing_to_go_by(spark):
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    page = '<html lang="DE-at"><script>var a = "the the the";</script><p>Die und der mit auf nicht ein.'
    df = spark.createDataFrame([(1, None, None), (2, "http://a.de/", page), (2, "http://a.de/", page), (None, "x", ""), (4, "http://b.fr/", "<p>" + LONG)], "page_id long, url string, html string").withColumns({"host": F.lit(1), "scores": F.lit(2)})
    rows = langid.identify(df, model).collect()
    assert len(rows) == 5 and all(r.lang for r in rows) and [r.declared for r in rows if r.page_id == 2] == ["de", "de"]
    assert next(r for r in rows if r.page_id == 1).text_lang is None
    assert langid.identify(df.limit(0), model).count() == 0
    nothing = langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert [r.lang for r in langid.identify(df, nothing).collect()] == [None] * 5
