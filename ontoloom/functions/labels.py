"""Label and URI functions, as Column expressions."""

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ontoloom.config import OWL, RDF, RDFS, SKOS

# Prefixes of wiki titles, each removed once, in this order.
PREFIXES = ["Category:", "Template:", "File:", "Property:", "Category_talk:", "User:"]
# Words that say nothing about a label.
STOPWORDS = [
    "a", "an", "the", "of", "in", "on", "at", "by", "for", "with",
    "about", "against", "between", "into", "through", "during",
    "before", "after", "above", "below", "to", "from", "up", "down",
    "and", "or", "is", "are", "was", "were", "be", "been", "being",
    "has", "have", "had", "do", "does", "did", "not",
]
#: white space as str.split() has it
BLANKS = r"[\s\x1c-\x1f\x85" + "".join(map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])) + "]+"
RESERVED = [RDF, RDFS, OWL, SKOS]


@F.pandas_udf(StringType())
def ascii_folded(text: pd.Series) -> pd.Series:
    """Compatibility decomposition with everything beyond ASCII dropped; Spark has no built-in for it."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def words(label: Column) -> Column:
    """The non-empty words of a label of single blanks."""
    return F.filter(F.split(label, " "), lambda w: w != "")


def _first(text: Column, pattern: str, n: int) -> Column:
    return F.array_join(F.slice(F.filter(F.split(text, pattern), lambda w: w != ""), 1, n), " ")


def camel_split(text: Column) -> Column:
    return F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")


def _head(text: Column, letter: str, n: int) -> Column:
    """The text up to its n-th run that has a ``letter``: all that can reach the first n words, so that no more is worked on."""
    return F.regexp_extract(text, f"^(?:[^{letter}]*+[{letter}][{letter}\\x{{80}}-\\x{{10FFFF}}]*+){{0,{n}}}[^{letter}]*+", 0)


def normalise_label(text: Column, max_words: int = 20, fold=ascii_folded) -> Column:
    """ASCII words in lower case, at most ``max_words``; null is ''."""
    # Prefixes are at most a dozen words; what else is cut or folded only ever splits words further.
    text = _head(F.coalesce(text, F.lit("")), "a-zA-Z0-9", max_words + 12)
    for prefix in PREFIXES:
        text = F.regexp_replace(text, f"^{prefix}", "")
    return _first(F.lower(F.regexp_replace(fold(camel_split(text)), "[^a-zA-Z0-9]", " ")), " ", max_words)


def normalise_label_v1(text: Column, max_words: int = 15) -> Column:
    """Words in lower case, split at blanks, '_' and '-'; accents and marks stay."""
    gap = BLANKS[1:-2] + "_-"
    text = F.regexp_extract(F.coalesce(text, F.lit("")), f"^(?:[{gap}]*+[^{gap}]++){{0,{max_words}}}", 0)
    return _first(F.lower(F.translate(camel_split(text), "_-", "  ")), BLANKS, max_words)


def uri_tail(uri: Column) -> Column:
    """After the last '/', then after the last '#'; %XX becomes a blank."""
    return F.regexp_replace(F.substring_index(F.substring_index(uri, "/", -1), "#", -1), "%[0-9A-Fa-f]{2}", " ")


def is_entity_uri(uri: Column) -> Column:
    """Neither of a core vocabulary nor an annotation of oboInOwl."""
    ours = ~F.contains(uri, F.lit("oboInOwl"))
    for space in RESERVED:
        ours = ours & ~F.startswith(uri, F.lit(space))
    return ours


def predicate_of(etype: Column, concept: str | None = None) -> Column:
    """The predicate that states an alignment of a type; ``concept`` overrides that of SKOS concepts."""
    plain = F.when(F.contains(etype, F.lit("Class")), OWL + "equivalentClass").when(F.contains(etype, F.lit("Property")), OWL + "equivalentProperty").otherwise(OWL + "sameAs")
    return plain if concept is None else F.when(F.contains(etype, F.lit("Concept")), concept).otherwise(plain)


def xml_escaped(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def symmetric_key(a: Column, b: Column) -> Column:
    return F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))


def sniffed_format(head: Column) -> Column:
    """rdfxml, functional, manchester, turtle or unknown, by the first 8 KiB of a file."""
    # What each syntax begins with.
    first = F.substring(head, 1, 2048)
    return (
        F.when(F.rlike(first, F.lit(r"<\?xml|<rdf:RDF|<Ontology[\s>]")), "rdfxml")
        .when(F.rlike(first, F.lit(r"\b(Ontology|Prefix|Declaration|SubClassOf|EquivalentClasses|AnnotationAssertion)\s*\(")), "functional")
        .when(F.rlike(head, F.lit(r"(?m)^\s*(Ontology|Class|ObjectProperty)\s*:")), "manchester")
        .when(F.rlike(head, F.lit(r"^\s*(@prefix|@base|PREFIX|BASE)|(?m)^\s*<[^>]+>\s+a\s+")), "turtle")
        .otherwise("unknown")
    )

