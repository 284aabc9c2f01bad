"""A Spark data source for ontologies: ``spark.read.format("rdf").load(path)`` gives triples.

Turtle, N-Triples, RDF/XML, OWL functional and Manchester syntax, by sniffing (or by suffix, option
``syntaxBy=suffix``); if the first choice does not parse, the others are tried; a file that none
parses raises, or with ``onError=skip`` gives nothing. Each file is one partition. N-Triples files
are read line by line in bounded memory; the other syntaxes need the whole file, as their grammar
does. Predicates wanted by a filter are applied while reading.
"""

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from ontoloom.config import OWL, RDF, RDFS, SKOS

SCHEMA = "subject string, s_is_iri boolean, predicate string, object string, o_kind string, lang string, datatype string"
XSD = "http://www.w3.org/2001/XMLSchema#"
XML = "http://www.w3.org/XML/1998/namespace"
#: subject, subject is an IRI, predicate, object, kind of object, language, datatype
Triple = tuple[str, bool, str, str, str, str | None, str | None]
SUFFIXES = {".ttl": "turtle", ".nt": "turtle", ".rdf": "rdfxml", ".owl": "rdfxml", ".xml": "rdfxml", ".ofn": "functional", ".omn": "manchester"}
BATCH = 10_000
#: bytes of an N-Triples file that one task reads
SPLIT = 64 << 20


class SyntaxProblem(ValueError):
    """Text that does not follow the syntax it is read as."""


def sniff(head: str) -> str:
    """As ontoloom.functions.labels.sniffed_format, for text at hand."""
    if re.search(r"<\?xml|<rdf:RDF|<Ontology[\s>]", head[:2048]):
        return "rdfxml"
    if re.search(r"\b(Ontology|Prefix|Declaration|SubClassOf|EquivalentClasses|AnnotationAssertion)\s*\(", head[:2048]):
        return "functional"
    if re.search(r"(?m)^\s*(Ontology|Class|ObjectProperty)\s*:", head):
        return "manchester"
    return "turtle" if re.match(r"\s*(@prefix|@base|PREFIX|BASE)", head) or re.search(r"(?m)^\s*<[^>]+>\s+a\s+", head) else "unknown"


# --- Turtle and N-Triples --------------------------------------------------------------------------------

_TURTLE = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\\\x00-\x20]*(?:\\u[0-9A-Fa-f]{4}[^<>"{}|^`\\\x00-\x20]*|\\U[0-9A-Fa-f]{8}[^<>"{}|^`\\\x00-\x20]*)*>)
    |(?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''')|(?P<text>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<directive>@prefix\b|@base\b|(?i:PREFIX|BASE)(?=\s))|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)
    |(?P<blank>_:[\w][\w.\-·]*(?<!\.))|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?<!\.))
    |(?P<name>[^\W\d_]?[\w\-·.]*:(?:[\w:%\-·]|\.(?=[\w:%\-])|\\.)*|:(?:[\w:%\-·]|\.(?=[\w:%\-])|\\.)*)|(?P<word>a\b|true\b|false\b)|(?P<mark>[.;,\[\]()])""",
    re.VERBOSE | re.DOTALL,
)
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}


def _plain(text: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _ESCAPES.get(m[1], m[1]), text, flags=re.DOTALL)


class _Turtle:
    def __init__(self, text: str, base: str):
        self.base, self.prefixes, self.fresh = base, {}, 0
        self.tokens = self._scan(text)
        self.now = next(self.tokens, ("end", ""))

    @staticmethod
    def _scan(text: str) -> Iterator[tuple[str, str]]:
        at = 0
        while at < len(text):
            m = _TURTLE.match(text, at)
            if not m:
                raise SyntaxProblem(f"turtle: {text[at:at + 30]!r}")
            at = m.end()
            if m.lastgroup != "skip":
                yield m.lastgroup, m[0]
        yield "end", ""

    def step(self) -> tuple[str, str]:
        had, self.now = self.now, next(self.tokens, ("end", ""))
        return had

    def mark(self, value: str) -> bool:
        if self.now == ("mark", value):
            self.step()
            return True
        return False

    def need(self, value: str) -> None:
        if not self.mark(value):
            raise SyntaxProblem(f"turtle: expected {value!r}, found {self.now[1]!r}")

    def blank(self) -> str:
        self.fresh += 1
        return f"_:g{self.fresh}"

    def iri(self) -> str:
        kind, value = self.step()
        if kind == "iri":
            return urljoin(self.base, _plain(value[1:-1])) if ":" not in value else _plain(value[1:-1])
        if kind == "name":
            prefix, _, local = value.partition(":")
            if prefix not in self.prefixes:
                raise SyntaxProblem(f"turtle: no prefix {prefix!r}")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        raise SyntaxProblem(f"turtle: expected an IRI, found {value!r}")

    def triples(self) -> Iterator[Triple]:
        while self.now[0] != "end":
            if self.now[0] == "directive":
                word = self.step()[1]
                if word.lower().lstrip("@") == "prefix":
                    name = self.step()[1]
                    self.prefixes[name[:-1]] = self.iri()
                else:
                    self.base = self.iri()
                if word[0] == "@":
                    self.need(".")
                continue
            out: list[Triple] = []
            if self.now == ("mark", "["):
                subject = self.node(out)[0]
                if self.now != ("mark", "."):
                    self.about(subject, out)
            else:
                subject, kind, _, _ = self.node(out)
                if kind == "literal":
                    raise SyntaxProblem("turtle: a literal is no subject")
                self.about(subject, out)
            self.need(".")
            yield from out

    def about(self, subject: str, out: list[Triple]) -> None:
        while True:
            if self.now == ("word", "a"):
                self.step()
                predicate = RDF + "type"
            else:
                predicate = self.iri()
            while True:
                value, kind, lang, datatype = self.node(out)
                out.append((subject, not subject.startswith("_:"), predicate, value, kind, lang, datatype))
                if not self.mark(","):
                    break
            if not self.mark(";"):
                return
            while self.mark(";"):
                pass
            if self.now[0] == "mark" and self.now[1] in ".]":
                return

    def node(self, out: list[Triple]) -> tuple[str, str, str | None, str | None]:
        kind, value = self.now
        if kind in ("iri", "name"):
            return self.iri(), "iri", None, None
        self.step()
        if kind == "blank":
            return value, "bnode", None, None
        if kind in ("text", "long"):
            said = _plain(value[3:-3] if kind == "long" else value[1:-1])
            if self.now[0] == "lang":
                return said, "literal", self.step()[1][1:].lower(), None
            if self.now[0] == "type":
                self.step()
                return said, "literal", None, self.iri()
            return said, "literal", None, None
        if kind == "number":
            return value, "literal", None, XSD + ("integer" if re.fullmatch(r"[+-]?\d+", value) else "double" if "e" in value.lower() else "decimal")
        if kind == "word" and value != "a":
            return value, "literal", None, XSD + "boolean"
        if (kind, value) == ("mark", "["):
            made = self.blank()
            if not self.mark("]"):
                self.about(made, out)
                self.need("]")
            return made, "bnode", None, None
        if (kind, value) == ("mark", "("):
            cells = []
            while not self.mark(")"):
                cells.append(self.node(out))
            rest: tuple = (RDF + "nil", "iri", None, None)
            for cell in reversed(cells):
                made = self.blank()
                out.append((made, False, RDF + "first", *cell))
                out.append((made, False, RDF + "rest", *rest))
                rest = (made, "bnode", None, None)
            return rest
        raise SyntaxProblem(f"turtle: unexpected {value!r}")


def turtle(text: str, base: str = "") -> Iterator[Triple]:
    return _Turtle(text, base).triples()


# --- RDF/XML ---------------------------------------------------------------------------------------------


def _split(tag: str) -> str:
    return tag[1:].replace("}", "", 1) if tag[0] == "{" else tag


def rdfxml(text: str, base: str = "") -> Iterator[Triple]:
    try:
        root = ET.fromstring(text)
    except ET.ParseError as why:
        raise SyntaxProblem(f"rdf/xml: {why}") from None
    if root.tag != f"{{{RDF}}}RDF":
        raise SyntaxProblem(f"rdf/xml: the root is {root.tag}")
    fresh = [0]

    def blank() -> str:
        fresh[0] += 1
        return f"_:x{fresh[0]}"

    def node(e: ET.Element, base: str, lang: str | None) -> Iterator[Triple | str]:
        """Triples of a node element; the last thing is its name."""
        base, lang = e.get(f"{{{XML}}}base", base), e.get(f"{{{XML}}}lang", lang)
        about, name, ident = (e.get(f"{{{RDF}}}{x}") for x in ("about", "nodeID", "ID"))
        s = urljoin(base, about) if about is not None else f"{base}#{ident}" if ident is not None else f"_:{name}" if name is not None else blank()
        iri = not s.startswith("_:")
        if e.tag != f"{{{RDF}}}Description":
            yield (s, iri, RDF + "type", _split(e.tag), "iri", None, None)
        for key, value in e.attrib.items():
            if not key.startswith((f"{{{RDF}}}", f"{{{XML}}}")) and key[0] == "{":
                yield (s, iri, _split(key), value, "literal", lang, None)
            elif key == f"{{{RDF}}}type":
                yield (s, iri, RDF + "type", urljoin(base, value), "iri", None, None)
        item = 0
        for p in e:
            predicate = _split(p.tag)
            if predicate == RDF + "li":
                item += 1
                predicate = f"{RDF}_{item}"
            yield from prop(s, iri, predicate, p, base, lang)
        yield s

    def inner(e: ET.Element, base: str, lang: str | None, out: list) -> str:
        *said, name = node(e, base, lang)
        out += said
        return name

    def prop(s: str, iri: bool, predicate: str, p: ET.Element, base: str, lang: str | None) -> Iterator[Triple]:
        base, lang = p.get(f"{{{XML}}}base", base), p.get(f"{{{XML}}}lang", lang)
        resource, name, kind, datatype = (p.get(f"{{{RDF}}}{x}") for x in ("resource", "nodeID", "parseType", "datatype"))
        kin = lambda x: "bnode" if x.startswith("_:") else "iri"
        out: list[Triple] = []
        if resource is not None:
            value = urljoin(base, resource)
            yield (s, iri, predicate, value, "iri", None, None)
        elif name is not None:
            yield (s, iri, predicate, f"_:{name}", "bnode", None, None)
        elif kind == "Resource":
            made = blank()
            yield (s, iri, predicate, made, "bnode", None, None)
            for q in p:
                yield from prop(made, False, _split(q.tag), q, base, lang)
        elif kind == "Collection":
            heads = [inner(x, base, lang, out) for x in p]
            rest = RDF + "nil"
            for head in reversed(heads):
                made = blank()
                out += [(made, False, RDF + "first", head, kin(head), None, None), (made, False, RDF + "rest", rest, kin(rest), None, None)]
                rest = made
            yield from out
            yield (s, iri, predicate, rest, kin(rest), None, None)
        elif kind == "Literal":
            yield (s, iri, predicate, (p.text or "") + "".join(ET.tostring(x, encoding="unicode") for x in p), "literal", None, RDF + "XMLLiteral")
        elif len(p):
            value = inner(p[0], base, lang, out)
            yield from out
            yield (s, iri, predicate, value, kin(value), None, None)
        else:
            yield (s, iri, predicate, p.text or "", "literal", None if datatype else lang and lang.lower(), datatype)

    top, lang = root.get(f"{{{XML}}}base", base), root.get(f"{{{XML}}}lang")
    for e in root:
        for t in node(e, top, lang):
            if isinstance(t, tuple):
                yield t


# --- OWL functional and Manchester syntax --------------------------------------------------------------

_KINDS = {"Class": "Class", "ObjectProperty": "ObjectProperty", "DataProperty": "DatatypeProperty", "NamedIndividual": "NamedIndividual", "AnnotationProperty": "AnnotationProperty", "Individual": "NamedIndividual", "DatatypeProperty": "DatatypeProperty"}
_STANDARD = {"owl": OWL, "rdf": RDF, "rdfs": RDFS, "xsd": XSD, "skos": SKOS}
_AXIOM = re.compile(r"""\s+|\#[^\n]*|(?P<text>"(?:[^"\\]|\\.)*")(?:@(?P<lang>[\w-]+)|\^\^(?P<type><[^>]*>|[\w.:-]+))?|(?P<open>\()|(?P<close>\))|(?P<atom><[^>]*>|[^\s()"<>]+)""", re.DOTALL)


def functional(text: str, base: str = "") -> Iterator[Triple]:
    """Declarations, annotations and subclass axioms between named classes."""
    prefixes = dict(_STANDARD)
    for m in re.finditer(r"Prefix\s*\(\s*([\w.-]*):\s*=\s*<([^>]*)>\s*\)", text):
        prefixes[m[1]] = m[2]
    if not re.search(r"\bOntology\s*\(", text):
        raise SyntaxProblem("functional: no Ontology(")

    def iri(atom: object) -> str | None:
        if not isinstance(atom, str):
            return None
        if atom[0] == "<":
            return atom[1:-1]
        prefix, colon, local = atom.partition(":")
        return prefixes[prefix] + local if colon and prefix in prefixes else None

    stack: list[list] = [[]]
    text, at = re.sub(r"Prefix\s*\([^)]*\)", "", text), 0
    while at < len(text):
        m = _AXIOM.match(text, at)
        if not m:
            raise SyntaxProblem(f"functional: {text[at:at + 30]!r}")
        at = m.end()
        if m["open"]:
            name = stack[-1].pop() if stack[-1] else ""
            stack.append([name])
        elif m["close"]:
            if len(stack) == 1:
                raise SyntaxProblem("functional: ')' without '('")
            done = stack.pop()
            stack[-1].append(done)
            args = [x for x in done[1:] if not (isinstance(x, list) and x and x[0] == "Annotation")]
            if done[0] == "Declaration" and args and isinstance(args[0], list) and args[0][0] in _KINDS and (s := iri(args[0][1])):
                yield (s, True, RDF + "type", OWL + _KINDS[args[0][0]], "iri", None, None)
            elif done[0] == "AnnotationAssertion" and len(args) >= 3 and (p := iri(args[0])) and (s := iri(args[1])):
                if isinstance(args[2], tuple):
                    yield (s, True, p, args[2][0], "literal", args[2][1], iri(args[2][2]) if args[2][2] else None)
                elif o := iri(args[2]):
                    yield (s, True, p, o, "iri", None, None)
            elif done[0] == "SubClassOf" and len(args) == 2 and (s := iri(args[0])) and (o := iri(args[1])):
                yield (s, True, RDFS + "subClassOf", o, "iri", None, None)
            elif done[0] == "ClassAssertion" and len(args) == 2 and (o := iri(args[0])) and (s := iri(args[1])):
                yield (s, True, RDF + "type", o, "iri", None, None)
        elif m["text"]:
            stack[-1].append((_plain(m["text"][1:-1]), m["lang"] and m["lang"].lower(), m["type"]))
        elif m["atom"]:
            stack[-1].append(m["atom"])
    if len(stack) != 1:
        raise SyntaxProblem("functional: '(' is not closed")


_FRAME = re.compile(r"(?m)^\s*(Class|ObjectProperty|DataProperty|AnnotationProperty|Individual)\s*:\s*(\S+)")
_SECTION = re.compile(r"(?m)^\s*(Annotations|SubClassOf|Types|[A-Z]\w*)\s*:(?=\s|$)")


def manchester(text: str, base: str = "") -> Iterator[Triple]:
    """Frames with their annotations and named superclasses."""
    prefixes = dict(_STANDARD)
    for m in re.finditer(r"(?m)^\s*Prefix\s*:\s*([\w.-]*):\s*<([^>]*)>", text):
        prefixes[m[1]] = m[2]
    frames = list(_FRAME.finditer(text))
    if not frames and not re.search(r"(?m)^\s*Ontology\s*:", text):
        raise SyntaxProblem("manchester: no frame")

    def iri(atom: str) -> str | None:
        if atom.startswith("<"):
            return atom.strip("<>")
        prefix, colon, local = atom.partition(":")
        return prefixes[prefix] + local if colon and prefix in prefixes else prefixes[""] + atom if not colon and "" in prefixes and re.fullmatch(r"[\w-]+", atom) else None

    for k, frame in enumerate(frames):
        s = iri(frame[2])
        if s is None:
            continue
        yield (s, True, RDF + "type", OWL + _KINDS[frame[1]], "iri", None, None)
        body = text[frame.end() : frames[k + 1].start() if k + 1 < len(frames) else len(text)]
        marks = list(_SECTION.finditer(body))
        for i, mark in enumerate(marks):
            said = body[mark.end() : marks[i + 1].start() if i + 1 < len(marks) else len(body)]
            if mark[1] == "Annotations":
                for a in re.finditer(r'(<[^>]+>|[\w-]*:?[\w-]+)\s+("(?:[^"\\]|\\.)*")(?:@([\w-]+))?', said, re.DOTALL):
                    if p := iri(a[1]):
                        yield (s, True, p, _plain(a[2][1:-1]), "literal", a[3] and a[3].lower(), None)
            elif mark[1] in ("SubClassOf", "Types"):
                for part in said.split(","):
                    if re.fullmatch(r"\s*(<[^>]+>|[\w-]*:?[\w-]+)\s*", part) and (o := iri(part.strip())):
                        yield (s, True, RDFS + "subClassOf" if mark[1] == "SubClassOf" else RDF + "type", o, "iri", None, None)


PARSERS = {"turtle": turtle, "rdfxml": rdfxml, "functional": functional, "manchester": manchester}


def parse(text: str, base: str = "", first: str | None = None) -> list[Triple]:
    """Triples of a whole text: the sniffed (or given) syntax first, then the others."""
    first = first or sniff(text[:8192])
    order = [first] if first in PARSERS else []
    order += [x for x in PARSERS if x not in order]
    why: Exception | None = None
    for syntax in order:
        try:
            return list(PARSERS[syntax](text, base))
        except SyntaxProblem as problem:
            why = why or problem
    raise SyntaxProblem(f"no syntax fits: {why}")


_NT = re.compile(r'\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(?:<([^>]*)>|(_:\S+)|("(?:[^"\\]|\\.)*")(?:@([\w-]+)|\^\^<([^>]*)>)?)\s*\.\s*(?:#.*)?$')


def ntriples_line(line: str) -> Triple | None:
    """The triple of a line; None for blanks and comments; SyntaxProblem otherwise."""
    if not line.strip() or line.lstrip().startswith("#"):
        return None
    m = _NT.match(line)
    if not m:
        raise SyntaxProblem(f"n-triples: {line[:60]!r}")
    s, iri = (m[1][1:-1], True) if m[1][0] == "<" else (m[1], False)
    if m[3] is not None:
        return (s, iri, m[2], _plain(m[3]), "iri", None, None)
    if m[4] is not None:
        return (s, iri, m[2], m[4], "bnode", None, None)
    return (s, iri, m[2], _plain(m[5][1:-1]), "literal", m[6] and m[6].lower(), m[7])


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.predicates = options, None

    def partitions(self) -> list[InputPartition]:
        """One a file; N-Triples, whose lines stand alone, are cut into ranges of SPLIT bytes."""
        where, path = fs.FileSystem.from_uri(self.options["path"])
        found = where.get_file_info(path)
        if found.type == fs.FileType.Directory:
            files = [x for x in where.get_file_info(fs.FileSelector(path, recursive=True)) if x.type == fs.FileType.File and not x.base_name.startswith(("_", "."))]
        elif found.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        else:
            files = [found]
        split = int(self.options.get("splitbytes", self.options.get("splitBytes", SPLIT)))
        ranges = [(x.path, at, min(at + split, x.size)) for x in sorted(files, key=lambda x: x.path) for at in (range(0, x.size, split) if x.path.endswith(".nt") else (0,))]
        return [InputPartition(x) for x in ranges] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names)
        rows: list[Triple] = []
        for t in self._triples(*partition.value) if partition.value is not None else ():
            if self.predicates is None or t[2] in self.predicates:
                rows.append(t)
                if len(rows) >= BATCH:
                    yield pack(rows)
                    rows = []
        yield pack(rows)

    def _lines(self, path: str, begin: int, end: int) -> Iterator[bytes]:
        """The lines that begin in a range of a file's bytes."""
        where, _ = fs.FileSystem.from_uri(self.options["path"])
        with where.open_input_file(path) as file:
            # From the byte before: only a line feed there lets a line begin at ``begin``.
            at, left, first = max(0, begin - 1), b"", begin > 0
            file.seek(at)
            while at < end:
                piece = file.read(1 << 20)
                *lines, left = (left + piece).split(b"\n") if piece else (left, b"")
                for line in lines:
                    if at >= end:
                        return
                    at += len(line) + 1
                    if first:
                        first = False
                    else:
                        yield line
                if not piece:
                    return

    def _triples(self, path: str, begin: int, end: int) -> Iterator[Triple]:
        where, _ = fs.FileSystem.from_uri(self.options["path"])
        skip = self.options.get("onerror", self.options.get("onError", "fail")) == "skip"
        if path.endswith(".nt"):
            for line in self._lines(path, begin, end):
                try:
                    found = ntriples_line(line.decode("utf-8", errors="replace"))
                except SyntaxProblem:
                    if not skip:
                        raise
                    continue
                if found is not None:
                    yield found
            return
        with where.open_input_stream(path) as stream:
            text = stream.read().decode("utf-8", errors="replace")
        suffix = re.search(r"\.\w+$", path)
        by_suffix = self.options.get("syntaxby", self.options.get("syntaxBy")) == "suffix"
        try:
            yield from parse(text, self.options.get("base", ""), SUFFIXES.get(suffix[0].lower(), "rdfxml") if by_suffix and suffix else None)
        except SyntaxProblem:
            if not skip:
                raise


class _PushingReader(_Reader):
    """For sessions with spark.sql.python.filterPushdown.enabled, which others refuse."""

    def pushFilters(self, filters: list):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("predicate",):
                self.predicates = {f.value}
            elif isinstance(f, In) and f.attribute == ("predicate",):
                self.predicates = set(f.value)
            yield f  # Spark applies it again: it may be more than one


class RdfSource(DataSource):
    """``format("rdf")``: options path (a file or folder), syntaxBy (content or suffix), base, onError (fail or skip),
    pushdown (true where the session allows it)."""

    @classmethod
    def name(cls) -> str:
        return "rdf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (_PushingReader if self.options.get("pushdown") == "true" else _Reader)(dict(self.options))


def read_triples(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(RdfSource)
    allowed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("rdf").options(pushdown=allowed, **options).load(path)
