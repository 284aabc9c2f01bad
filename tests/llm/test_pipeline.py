"""The whole pipeline against a plain Python one that shares no code with it."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline

SF = "/root/testdata/sf0.001"
PROSE = "The heart valve opens when pressure rises. It closes again as the pressure falls, and so on."


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# --- stage 1 -----------------------------------------------------------------------------------------------

PHRASES = """all rights reserved;terms of use;terms of service;privacy policy;cookie policy;use of cookies;licensed under;subject to the license;javascript;lorem ipsum;
sign up for our newsletter;powered by;alle rechte vorbehalten;nutzungsbedingungen;verwendung von cookies;tous droits réservés;conditions d'utilisation;
politique de confidentialité;todos los derechos reservados;condiciones de uso;política de privacidad""".replace("\n", "").split(";")
SEPARATORS = "> >> / :: · • » › →".split()


def line_fails(line):
    words = re.findall(r"[^\x20\x09-\x0D]+", line)
    n, low = len(words), lower(line)
    menu = line.count("|") + sum(w in SEPARATORS for w in words)
    links = sum(lower(w).startswith(("http://", "https://", "www.")) for w in words)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    ends = words[-1][-1] in ".!?\"')]:;" or ord(words[-1][-1]) > 127
    return (
        (menu >= 3 and menu >= 0.2 * n) or (links >= 2 and links > 0.5 * n) or len(re.findall(r"[#*$%&|<>]", line)) > 0.3 * max(n, 3) or len(re.findall("[!?]", line)) > 0.4 * max(n, 3)
        or (n < 3 and not ends) or again > 0.3 * max(n, 6) or any(p in low for p in PHRASES)
    )


def cleaned(text):
    """The text without failed lines, or None if the document goes."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 5)}
    if len(words) < 10 or 100 * len(repeated) > 20 * len(words):
        return None
    said = lambda line: re.findall(r"[^\x20\x09-\x0D]+", line)
    lines = [x for x in text.split("\n") if not said(x) or not line_fails(x)]
    return "\n".join(lines) if sum(len(said(x)) for x in lines) >= 0.5 * len(words) else None


# --- stage 2 -----------------------------------------------------------------------------------------------


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def one_of_each(rows):
    """(id, text) of the row with the smallest id of each component."""
    rows, prints = sorted(rows, key=lambda r: r[0]), {}
    kept, group = [], []
    for i, text in rows:
        prints[i] = fingerprint(text)
    todo = dict(rows)
    while todo:
        group = [min(todo)]
        kept.append((group[0], todo.pop(group[0])))
        while group:
            p = prints[group.pop()]
            near = [i for i in todo if (prints[i] ^ p).bit_count() <= 2]
            for i in near:
                del todo[i]
            group += near
    return kept


# --- stages 3 and 4 ------------------------------------------------------------------------------------------


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def clean_of(rows, items):
    """Rows that hold no ten words in a row of an item, nor a whole shorter item."""
    told = {}
    for item in items:
        w = words_of(item)
        for i in range(max(1, len(w) - 9) if w else 0):
            told.setdefault(min(10, len(w)), set()).add(tuple(w[i : i + 10]))
    return [(i, t) for i, t in rows if not any(tuple(w[k : k + n]) in said for w in [words_of(t)] for n, said in told.items() for k in range(len(w) - n + 1))]


SECRETS = [
    (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6), (r"AKIA[A-Z0-9]+", 0, 20), (r"[0-9a-f]+", 0, 24), (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    (r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 0), (r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
]


def without_secrets(text):
    spans = sorted((m.start(), m.end()) for p, g, n in SECRETS for m in re.finditer(p, text, re.ASCII) if len(m[g]) >= n)
    out, at = [], 0
    for a, b in spans:
        if a >= at:
            out += [text[at:a], "[REDACTED]"]
        at = max(at, b)
    return "".join(out) + text[at:]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The documents, and some for each stage; the benchmark."""
    place = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    more = [PROSE, PROSE, PROSE + "\nHome | News | About | Contact\nAll rights reserved.", PROSE.replace("heart", "mitral") + " token=abcdef123 AKIA" + "B2" * 9, "Nothing alike here, so it says, and then it goes: " + items[0], None, "", "word " * 30, PROSE + " eyJabcdefgh.abcdefgh.x"]
    rows = [(10**6 + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(more)]
    docs.unionByName(spark.createDataFrame(rows, docs.schema)).repartition(5).write.parquet(str(place / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(place / "benchmark.parquet"))
    return str(place), items


def test_pipeline_equals_brute_force(spark, tables):
    import public_tokenizers
    from tokenizers import Tokenizer

    place, items = tables
    rows = [(r.doc_id, cleaned(r.text)) for r in spark.read.parquet(f"{place}/documents.parquet").collect()]
    rows = one_of_each([r for r in rows if r[1] is not None])
    rows = {i: without_secrets(t) for i, t in clean_of(rows, items)}
    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: [*full.encode(t, add_special_tokens=False).ids, 1] for i, t in rows.items()}
    got, filled = {}, {}
    for r in sorted(corpus_pipeline.run(spark, place).collect(), key=lambda r: (r.doc_id, r.start)):
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == len(got.setdefault(r.doc_id, [])) and len(ids) == r.length and r.ids_crc32 == zlib.crc32(r.ids)
        got[r.doc_id] += ids
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want and len(got) > 20
    for seq, pieces in filled.items():
        pieces.sort()
        assert [a for a, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))] and (sum(n for _, n in pieces) == 2048 or seq == max(filled))
