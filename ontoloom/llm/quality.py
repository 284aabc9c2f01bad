"""Quality rules, line first: lines that fail go, then documents that lose too much text go.

Per line, in this order: *navigation* (menus and breadcrumbs: many separators between short items; or mostly
links), *punctuation* (symbols or shouting marks on the words, or a stub without an end mark) and *boilerplate*
(known phrases, or words that stutter). A document is rejected if fewer than KEEP of its words stand on lines that
passed. Every verdict depends on the document's own text alone.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.llm import text as T

#: share of its words that a document must keep
KEEP = 0.5
#: fewest separators of a menu, and their share of the line's words
MENU, MENU_SHARE = 3, 0.2
#: words that are separators if they stand alone; a bar is one anywhere
SEPARATORS = [">", ">>", "/", "::", "·", "•", "»", "›", "→"]
#: what links begin with, fewest of them, and the share of the line's words that they must exceed
LINKS, LINKED, LINK_SHARE = ["http://", "https://", "www."], 2, 0.5
#: symbols or shouting marks a word at which a line is noise
SYMBOLS, SHOUTS = 0.3, 0.4
#: lines of fewer words must end in an end mark
STUB = 3
#: share of a line's words that equal the word before
STUTTER = 0.3
#: fixed phrases of boilerplate, lower case, in English, German, French and Spanish
PHRASES = [
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use of cookies",
    "licensed under", "subject to the license", "javascript", "lorem ipsum", "sign up for our newsletter", "powered by",
    "alle rechte vorbehalten", "nutzungsbedingungen", "verwendung von cookies",
    "tous droits réservés", "conditions d'utilisation", "politique de confidentialité",
    "todos los derechos reservados", "condiciones de uso", "política de privacidad",
]
#: 5 words a window, as the contract has them
WINDOW = 5

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_kept_words long, base_failed boolean, kept boolean"


def _table(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), list(chars))


_SYMBOLS, _SHOUTS, _MENU, _ENDS = _table(b"#*$%&|<>"), _table(b"!?"), _table(b"|"), _table(b".!?\"')]:;")
_PHRASES = re.compile(b"|".join(re.escape(p.encode()) for p in PHRASES))


def _marked(words: T.Words) -> tuple[np.ndarray, np.ndarray]:
    """Of each word: whether it is a separator that stands alone, and whether it begins like a link."""
    size = words.end - words.start
    alone, link = np.zeros(len(size), bool), np.zeros(len(size), bool)
    low = T.lower(words.data)
    for said, flags, whole in [*((x, alone, True) for x in SEPARATORS), *((x, link, False) for x in LINKS)]:
        raw = said.encode()
        left = np.flatnonzero(size == len(raw) if whole else size >= len(raw))
        for i, byte in enumerate(raw):
            left = left[low[words.start[left] + i] == byte]
        flags[left] = True
    return alone, link


def measure(at: np.ndarray, data: np.ndarray) -> dict[str, np.ndarray]:
    """Of each text: the contract's counts, words on lines that passed, and which lines passed."""
    words = T.Words(at, data, T.NOT_SPACE)
    n_texts, n_words = len(at) - 1, len(words.start)
    within = lambda flags, edges: T.per_text(flags.astype(np.int64), edges)
    chars = within(words.mask & ((data & 0xC0) != 0x80), at)
    # Lines: a text of k line feeds has k + 1.
    feeds = np.flatnonzero(data == 0x0A)
    feeds_in = np.searchsorted(feeds, at)
    line_from = np.sort(np.concatenate([at[:-1], feeds + 1]), kind="stable")
    lines_first = np.arange(n_texts + 1) + feeds_in
    line_to = np.empty_like(line_from)
    line_to[:-1], line_to[-1:] = line_from[1:] - 1, at[-1:]
    line_to[lines_first[1:] - 1] = at[1:]
    line_text = np.repeat(np.arange(n_texts), np.diff(lines_first))
    word_edge = np.searchsorted(words.start, line_from)
    word_stop = np.searchsorted(words.start, line_to)
    line_words = word_stop - word_edge
    full = line_words > 0
    # Lines equal to an earlier one of their text.
    key = T.mix(T.spans(data, line_from, line_to) ^ line_text.astype(T.U64) * T.U64(0x9E3779B97F4A7C15))[full]
    owner = line_text[full]
    _, first_seen = np.unique(key, return_index=True)
    dup_lines = np.bincount(owner, minlength=n_texts) - np.bincount(owner[first_seen], minlength=n_texts)
    hashes = words.hashes()
    # Words in windows that the text has twice or more.
    if n_words >= WINDOW:
        fits = words.windows(WINDOW)[: n_words - WINDOW + 1]
        own = words.text_of()[: n_words - WINDOW + 1]
        begin = np.flatnonzero(fits)
        key = T.mix(T.rolled(hashes, WINDOW) ^ own.astype(T.U64) * T.U64(0x9E3779B97F4A7C15))[begin]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        repeat = within(T.covered(begin[twice], WINDOW, n_words), words.first)
    else:
        repeat = np.zeros(n_texts, np.int64)
    # The method: each line alone.
    totals = lambda table: np.concatenate([[0], np.cumsum(table[data])])
    of_line = lambda total: total[line_to] - total[line_from]
    symbols = totals(_SYMBOLS)
    menu = of_line(totals(_MENU))
    last = words.end[np.maximum(word_stop - 1, 0)] - 1 if n_words else np.zeros(len(line_from), np.int64)
    ends = _ENDS[data[last]] | (data[last] >= 0x80) if n_words else np.zeros(len(line_from), bool)
    alone, link = _marked(words)
    of_words = lambda flags: (total := np.concatenate([[0], np.cumsum(flags)]))[word_stop] - total[word_edge]
    menu = menu + of_words(alone)
    bad = (menu >= MENU) & (menu >= MENU_SHARE * line_words)
    linked = of_words(link)
    bad |= (linked >= LINKED) & (linked > LINK_SHARE * line_words)
    bad |= of_line(symbols) > SYMBOLS * np.maximum(line_words, 3)
    bad |= of_line(totals(_SHOUTS)) > SHOUTS * np.maximum(line_words, 3)
    bad |= (line_words < STUB) & ~ends
    again = np.concatenate([[0], np.cumsum(np.concatenate([[False], hashes[1:] == hashes[:-1]]))]) if n_words else np.zeros(1, np.int64)
    bad |= again[word_stop] - again[np.minimum(word_edge + 1, word_stop)] > STUTTER * np.maximum(line_words, 6)
    # Texts are set apart by line feeds, which no phrase has, so that none is found across two of them.
    apart = np.insert(T.lower(data), at[1:-1], 0x0A).tobytes()
    found = np.array([m.start() for m in _PHRASES.finditer(apart)], np.int64)
    found -= np.searchsorted(at[1:-1] + np.arange(max(0, n_texts - 1)), found)
    bad[np.searchsorted(line_from, found, "right") - 1] = True
    passed = full & ~bad
    kept = T.per_text(np.where(passed, line_words, 0), lines_first)
    count = words.count.astype(np.int64)
    failed = (count < 10) | (100 * repeat > 20 * count)
    return {
        "n_words": count, "word_chars": chars, "n_symbols": symbols[at[1:]] - symbols[at[:-1]], "n_dup_lines": dup_lines.astype(np.int64), "n_repeat_words": repeat, "n_kept_words": kept,
        "base_failed": failed, "kept": ~failed & (kept >= KEEP * count), "bad_line": full & bad, "line_from": line_from, "line_to": line_to, "lines_first": lines_first,
    }


def _rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")][1:]
    for batch in batches:
        for part in T.chunks(batch, "text"):
            got = measure(*T.buffers(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(got[n]) for n in names]], ["doc_id", *names])


def rate(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: the counts, the base verdict and the line-first verdict.

    A null or empty text has no words and is base_failed; a null doc_id stays null; repeated rows are judged each, alike;
    other columns do not matter; an empty table gives an empty one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_rate, SCHEMA)


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in T.chunks(batch, "text"):
            at, data = T.buffers(part.column("text"))
            got = measure(at, data)
            stay = np.flatnonzero(got["kept"])
            out = part.take(pa.array(stay))
            bad = T.per_text(got["bad_line"].astype(np.int64), got["lines_first"])[stay] > 0
            texts = out.column("text").to_pylist() if bad.any() else None
            if texts:
                raw = data.tobytes()
                for k in np.flatnonzero(bad):
                    a, b = got["lines_first"][stay[k]], got["lines_first"][stay[k] + 1]
                    texts[k] = b"\n".join(raw[got["line_from"][i] : got["line_to"][i]] for i in range(a, b) if not got["bad_line"][i]).decode()
                out = out.set_column(out.schema.get_field_index("text"), out.schema.field("text"), pa.array(texts, out.schema.field("text").type))
            yield out


def clean(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``: rejected documents gone, failed lines gone from the others, ``n_chars`` brought up to date.

    Null and empty texts are rejected; ids do not matter, so rows that share one or have none, and repeated rows, are
    judged each by its own text; an empty table stays empty."""
    out = docs.mapInArrow(_cleaned, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_QUOTED = lambda x: "'" + x.replace("'", "''") + "'"
_HAS = " or ".join(f"contains(low, {_QUOTED(p)})" for p in PHRASES)
_ALONE = ", ".join(map(_QUOTED, SEPARATORS))
_LINK = " or ".join(f"starts_with(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_QUOTED(p)})" for p in LINKS)
ORACLE = rf"""
with d as (select row_number() over () as rn, doc_id, coalesce(text, '') as t from documents),
w as (select rn, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from d),
win as (select rn, i, array_to_string(w[i : i + 4], ' ') as s from (select rn, w, unnest(range(1, len(w) - 3)) as i from w where len(w) >= 5)),
twice as (select rn, s from win group by rn, s having count(*) > 1),
rep as (select rn, count(distinct p) as n from (select rn, unnest(range(i, i + 5)) as p from win join twice using (rn, s)) group by rn),
ln as (select rn, l, regexp_extract_all(l, '[^\x20\x09-\x0D]+') as lw, translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low from (select rn, unnest(string_split(t, chr(10))) as l from d)),
f as (select rn, l, low, lw, len(lw) as n, length(l) - length(replace(l, '|', '')) + len(list_filter(lw, lambda x: x in ({_ALONE}))) as menu, len(list_filter(lw, lambda x: {_LINK})) as linked, len(regexp_extract_all(l, '[#*$%&|<>]')) as sym, len(regexp_extract_all(l, '[!?]')) as shout,
  regexp_matches(lw[-1], '[.!?"'')\]:;]$|[^\x00-\x7F]$') as ends, len(list_filter(range(2, len(lw) + 1), lambda i: lw[i] = lw[i - 1])) as again from ln where len(lw) > 0),
v as (select *, (menu >= {MENU} and menu >= {MENU_SHARE}::double * n) or (linked >= {LINKED} and linked > {LINK_SHARE}::double * n) or sym > {SYMBOLS}::double * greatest(n, 3) or shout > {SHOUTS}::double * greatest(n, 3) or (n < {STUB} and not ends)
  or again > {STUTTER}::double * greatest(n, 6) or {_HAS} as bad from f),
k as (select rn, count(*) - count(distinct l) as dup, coalesce(sum(n) filter (not bad), 0) as kept from v group by rn),
o as (select doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols,
  coalesce(dup, 0)::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words, coalesce(kept, 0)::bigint as n_kept_words from w left join rep using (rn) left join k using (rn))
select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and n_kept_words >= {KEEP}::double * n_words as kept from o
"""
