"""Chat formatting: a compiler for a small sandboxed template language.

A template is parsed into a syntax tree, constant parts are folded, and the tree becomes nested
Python closures that append to a buffer; ``{% generation %}`` blocks mark the spans a model is
trained on. The language has ``{{ expr }}``, ``{% for x in expr %}``, ``{% if %} / {% elif %} /
{% else %}``, ``{% set x = expr %}`` and ``{% generation %}``; expressions have literals, names,
``.field``, ``[index]``, ``not and or == != < <= > >= in + ~ %`` and filters from FILTERS. There are
no calls, no attributes of Python objects and no imports: only keys of dicts and items of lists.

Control strings inside texts are escaped reversibly: each backslash is doubled and each control
string gets a backslash after its first character, so none is left whole; undoing drops each
backslash that escapes.
"""

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: fixed control strings of the formats in use; none is part of another, and none overlaps another
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|role|>", "<|text|>", "<|end|>"]
_ESCAPE = re.compile("|".join([r"\\", *map(re.escape, CONTROLS)]))
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)

TEMPLATE = (
    "{% for m in messages %}"
    "{% if m.role == 'user' %}[INST]{{ m.text | escape }}[/INST]"
    "{% elif m.role == 'system' %}<<SYS>>{{ m.text | escape }}<</SYS>>"
    "{% elif m.role == 'assistant' %}<s>{% generation %}{{ m.text | escape }}{% endgeneration %}</s>"
    "{% else %}<|role|>{{ m.role | escape }}<|text|>{{ m.text | escape }}<|end|>"
    "{% endif %}{% endfor %}"
)


class TemplateError(ValueError):
    """A template that does not parse, or an operation the sandbox does not have."""


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1], text)


FILTERS: dict[str, Callable] = {"escape": lambda x: escape(_text(x)), "trim": lambda x: _text(x).strip(), "upper": lambda x: _text(x).upper(), "lower": lambda x: _text(x).lower(), "length": len, "first": lambda x: x[0] if x else "", "last": lambda x: x[-1] if x else "", "string": lambda x: _text(x)}


def _text(x: object) -> str:
    return "" if x is None else str(x)


# --- scanning ------------------------------------------------------------------------------------

_PIECE = re.compile(r"\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.DOTALL)
_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+)|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>+~%.\[\]()|,=]))""", re.DOTALL)
_STRING = {"n": "\n", "t": "\t", "r": "\r"}


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"cannot read {source[at:at + 20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


def _pieces(source: str) -> Iterator[tuple[str, str]]:
    at, trim = 0, False
    for m in _PIECE.finditer(source):
        before = source[at : m.start()]
        before = before.lstrip() if trim else before
        yield "data", before.rstrip() if m[0][2] == "-" else before
        at, trim = m.end(), m[0][-3] == "-"
        if m[1] is not None:
            yield "expr", m[1]
        elif m[2] is not None:
            yield "tag", m[2].strip()
    yield "data", source[at:].lstrip() if trim else source[at:]


# --- parsing: nodes are tuples whose first item names them ------------------------------------------


class _Parser:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str):
        self.tokens, self.i = _tokens(source), 0

    def peek(self, *values: str) -> bool:
        return self.i < len(self.tokens) and self.tokens[self.i][0] != "str" and self.tokens[self.i][1] in values

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.i += 1
            return self.tokens[self.i - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"expected {value!r}")

    def whole(self) -> tuple:
        node = self.either()
        if self.i != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.i][1]!r}")
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        node = self.summed()
        while op := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
            node = (op, node, self.summed())
        return node

    def summed(self) -> tuple:
        node = self.filtered()
        while op := self.take("+", "~", "%"):
            node = (op, node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.atom()
        while True:
            if self.take("|"):
                kind, name = self.tokens[self.i] if self.i < len(self.tokens) else ("", "")
                if kind != "name" or name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                self.i += 1
                node = ("filter", name, node)
            elif self.take("."):
                kind, name = self.tokens[self.i] if self.i < len(self.tokens) else ("", "")
                if kind != "name" or name.startswith("_"):
                    raise TemplateError(f"no field {name!r}")
                self.i += 1
                node = ("item", node, ("const", name))
            elif self.take("["):
                node = ("item", node, self.either())
                self.need("]")
            else:
                return node

    def atom(self) -> tuple:
        if self.take("("):
            node = self.either()
            self.need(")")
            return node
        if self.i >= len(self.tokens):
            raise TemplateError("an expression ends early")
        kind, value = self.tokens[self.i]
        self.i += 1
        if kind == "num":
            return ("const", int(value))
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: _STRING.get(m[1], m[1]), value[1:-1], flags=re.DOTALL))
        if kind == "name":
            known = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
            return ("const", known[value]) if value in known else ("name", value)
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> list[tuple]:
    """The syntax tree of a template: a list of nodes."""
    stack: list[tuple[str, list]] = [("", [])]
    branches: list[list] = []
    for kind, piece in _pieces(source):
        body = stack[-1][1]
        if kind == "data":
            if piece:
                body.append(("data", piece))
            continue
        if kind == "expr":
            body.append(("print", _Parser(piece).whole()))
            continue
        word, _, rest = piece.partition(" ")
        if word == "for":
            m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.DOTALL)
            if not m:
                raise TemplateError(f"cannot read 'for {rest}'")
            inner: list = []
            body.append(("for", m[1], _Parser(m[2]).whole(), inner))
            stack.append(("for", inner))
        elif word == "if":
            inner = []
            branches.append([(_Parser(rest).whole(), inner)])
            body.append(("if", branches[-1]))
            stack.append(("if", inner))
        elif word in ("elif", "else"):
            if stack[-1][0] != "if":
                raise TemplateError(f"{word} outside if")
            inner = []
            branches[-1].append((_Parser(rest).whole() if word == "elif" else ("const", True), inner))
            stack[-1] = ("if", inner)
        elif word == "set":
            name, eq, value = rest.partition("=")
            if not eq or not re.fullmatch(r"\s*[A-Za-z]\w*\s*", name):
                raise TemplateError(f"cannot read 'set {rest}'")
            body.append(("set", name.strip(), _Parser(value).whole()))
        elif word == "generation":
            inner = []
            body.append(("generation", inner))
            stack.append(("generation", inner))
        elif word in ("endfor", "endif", "endgeneration"):
            if stack.pop()[0] != word[3:] or not stack:
                raise TemplateError(f"{word} without its beginning")
            if word == "endif":
                branches.pop()
        else:
            raise TemplateError(f"no tag {word!r}")
    if len(stack) != 1:
        raise TemplateError(f"{stack[-1][0]} is not ended")
    return stack[0][1]


_BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b, "+": lambda a, b: a + b, "~": lambda a, b: _text(a) + _text(b), "%": lambda a, b: a % b if isinstance(a, int) else _refuse("% of a text"),
}


def _refuse(what: str):
    raise TemplateError(f"the sandbox has no {what}")


def _item(holder: object, key: object) -> object:
    if isinstance(holder, dict):
        return holder.get(key)
    if isinstance(holder, list | str) and isinstance(key, int):
        return holder[key] if -len(holder) <= key < len(holder) else None
    return None if holder is None else _refuse(f"field {key!r} of {type(holder).__name__}")


def fold(node: tuple) -> tuple:
    """An expression with its constant parts worked out."""
    if node[0] in ("const", "name"):
        return node
    parts = tuple(fold(x) if isinstance(x, tuple) else x for x in node[1:])
    node = (node[0], *parts)
    if all(x[0] == "const" for x in parts if isinstance(x, tuple)):
        return ("const", _expression(node)({}))
    if node[0] == "and" and parts[0][0] == "const":
        return parts[1] if parts[0][1] else parts[0]
    if node[0] == "or" and parts[0][0] == "const":
        return parts[0] if parts[0][1] else parts[1]
    return node


def fold_body(body: list[tuple]) -> list[tuple]:
    """Statements with constants folded: prints of constants become data, dead branches go, data runs join."""
    out: list[tuple] = []
    for node in body:
        if node[0] == "print":
            value = fold(node[1])
            node = ("data", _text(value[1])) if value[0] == "const" else ("print", value)
        elif node[0] == "for":
            node = ("for", node[1], fold(node[2]), fold_body(node[3]))
        elif node[0] == "set":
            node = ("set", node[1], fold(node[2]))
        elif node[0] == "generation":
            node = ("generation", fold_body(node[1]))
        elif node[0] == "if":
            alive = []
            for test, inner in node[1]:
                test = fold(test)
                if test[0] == "const" and not test[1]:
                    continue
                alive.append((test, fold_body(inner)))
                if test[0] == "const":
                    break
            if not alive:
                continue
            if alive[0][0][0] == "const":
                for x in alive[0][1]:
                    _add(out, x)
                continue
            node = ("if", alive)
        _add(out, node)
    return out


def _add(out: list[tuple], node: tuple) -> None:
    if node[0] == "data" and out and out[-1][0] == "data":
        out[-1] = ("data", out[-1][1] + node[1])
    elif node != ("data", ""):
        out.append(node)


# --- closures ----------------------------------------------------------------------------------------


def _expression(node: tuple) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        return lambda env, value=node[1]: value
    if kind == "name":
        return lambda env, name=node[1]: env.get(name)
    if kind == "not":
        return lambda env, f=_expression(node[1]): not f(env)
    if kind == "filter":
        return lambda env, f=_expression(node[2]), g=FILTERS[node[1]]: g(f(env))
    a, b = _expression(node[1]), _expression(node[2])
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)
    if kind == "item":
        return lambda env: _item(a(env), b(env))
    return lambda env, g=_BINARY[kind]: g(a(env), b(env))


class _Out:
    """What has been rendered, and the spans marked as generation."""

    def __init__(self):
        self.parts, self.n, self.marked = [], 0, []

    def put(self, text: str) -> None:
        self.parts.append(text)
        self.n += len(text)


def _statements(body: list[tuple]) -> Callable[[dict, _Out], None]:
    steps = [_statement(node) for node in body]
    if len(steps) == 1:
        return steps[0]

    def run(env, out):
        for step in steps:
            step(env, out)

    return run


def _statement(node: tuple) -> Callable[[dict, _Out], None]:
    kind = node[0]
    if kind == "data":
        return lambda env, out, text=node[1]: out.put(text)
    if kind == "print":
        return lambda env, out, f=_expression(node[1]): out.put(_text(f(env)))
    if kind == "set":

        def assign(env, out, name=node[1], f=_expression(node[2])):
            env[name] = f(env)

        return assign
    if kind == "generation":

        def mark(env, out, run=_statements(node[1])):
            begin = out.n
            run(env, out)
            out.marked.append((begin, out.n))

        return mark
    if kind == "if":
        tests = [(_expression(t), _statements(b)) for t, b in node[1]]

        def choose(env, out):
            for test, run in tests:
                if test(env):
                    return run(env, out)
            return None

        return choose
    name, items, run = node[1], _expression(node[2]), _statements(node[3])

    def loop(env, out):
        rows = items(env) or []
        inner = dict(env)
        for i, row in enumerate(rows):
            inner[name] = row
            inner["loop"] = {"index0": i, "index": i + 1, "first": i == 0, "last": i == len(rows) - 1}
            run(inner, out)

    return loop


def compile_template(source: str) -> Callable[..., tuple[str, list[tuple[int, int]]]]:
    """render(**names) -> (text, spans of generation) for a template."""
    run = _statements(fold_body(parse(source)))

    def render(**names):
        out = _Out()
        run(names, out)
        return "".join(out.parts), out.marked

    return render


# --- reading formatted conversations back ----------------------------------------------------------------

_TURN = re.compile(r"\[INST\](?P<user>.*?)\[/INST\]|<<SYS>>(?P<system>.*?)<</SYS>>|<s>(?P<assistant>.*?)</s>|<\|role\|>(?P<role>.*?)<\|text\|>(?P<text>.*?)<\|end\|>", re.DOTALL)


def turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of what TEMPLATE rendered; raises ValueError on anything else."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        at = m.end()
        role = m.lastgroup
        out.append((unescape(m["role"]), unescape(m["text"])) if role == "text" else (role, unescape(m[role])))
    if at != len(formatted):
        raise ValueError(f"no turn begins at {at}")
    return out


def _rendered(batches: Iterator[pa.RecordBatch], template: str) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn -> one row per conversation: text and marked spans."""
    render, now, held, done = compile_template(template), None, [], []
    kinds = [pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))]

    def close():
        text, marked = render(messages=held)
        done.append((now[0], text, [list(x) for x in marked]))

    def pack():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], ["conv_id", "formatted", "marked"])

    for batch in batches:
        for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if now is None or now[0] != conv_id:
                if now is not None:
                    close()
                now, held = (conv_id,), []
            held.append({"role": role or "", "text": text or ""})
        if done:
            yield pack()
            done = []
    if now is not None:
        close()
        yield pack()


def render_conversations(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, formatted, marked (spans of generation) per conversation, its rows in order of turn.

    Null role and text are empty; a null turn comes first, ties in order of role and text; a null conv_id is a
    conversation. A conversation is one text, so it is rendered by one task, which holds one conversation at a time.
    """
    slim = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    ordered = slim.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(lambda b: _rendered(b, template), "conv_id long, formatted string, marked array<array<long>>")


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for batch in batches:
        rows = []
        for conv_id, text, marked in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            said = turns(text)
            loss = "".join(unescape(text[a:b]) for a, b in marked)
            rows.append((conv_id, len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(loss), sha(loss), len(text)))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in READ.split(", ")])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return render_conversations(rows.unionByName(more)).mapInArrow(_read, READ)


ORACLE = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select * from (values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
e as (select *, length(regexp_replace(regexp_replace(text, '\\', '\\\\', 'g'), '(<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|role\|>|<\|text\|>|<\|end\|>)', '\\\1', 'g')) as n from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(n + case role when 'user' then 13 when 'system' then 15 when 'assistant' then 7 else 23 + length(role) end)::bigint as formatted_chars
from e group by conv_id
"""
