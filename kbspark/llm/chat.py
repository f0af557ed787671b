r"""Chat formatting by a compiled template language.

A template is parsed into a syntax tree, constants are folded and neighbouring constant output is joined, and the rest
becomes Python closures; nothing of a template is evaluated as Python, there are no calls and no attributes other than
the fields of a message and of ``loop``, so a template is sandboxed by construction.

    {{ expr }}                                     output
    {% for m in messages %} ... {% endfor %}       loop.first, loop.index, loop.index0
    {% if expr %} ... {% elif %} ... {% else %} ... {% endif %}
    {% set name = expr %}
    {% generation %} ... {% endgeneration %}       output under the loss mask

Expressions: strings, integers, names, ``m.field`` or ``m['field']``, ``== != in not and or``, ``~`` or ``+`` (joined as
text), parentheses, and the filters ``trim``, ``upper``, ``lower``, ``escape`` and ``line``.  ``escape`` puts one more
backslash into every ``<``, backslashes, ``|``, so that no control string ``<|...|>`` survives in a text; ``line`` writes
backslashes and newlines as escapes.  Both are undone exactly by ``unescape`` and ``unline``.

``render`` sorts the messages of a conversation and streams them through the template, so a conversation may be longer
than memory: its output comes in parts of about ``part_chars`` characters, cut between messages.  ``read_back`` parses
the output again, from its marks alone.

Defined results: a null text or role is an empty one; a null conversation id is a conversation of its own; messages are
ordered by turn (nulls first), then role and text, so ties and repeated rows have a fixed order and all are kept; an
empty table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
CHATML = (
    "{% for m in messages %}{{ '<|im_start|>' ~ (m.role | line | escape) ~ '\\n' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}{{ '<|im_end|>' ~ '\\n' }}{% endfor %}"
)


class TemplateError(ValueError):
    """The template is not of the language."""


def escape(s: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", s)


def unescape(s: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", s)


def line(s: str) -> str:
    return s.replace("\\", "\\\\").replace("\n", "\\n")


def unline(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], s)


FILTERS: dict[str, Callable[[str], str]] = {
    "trim": str.strip, "upper": str.upper, "lower": str.lower, "escape": escape, "line": line}
_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)"""
                    r"""|(?P<op>==|!=|[~+|.()\[\]=]))""")
_QUOTED = {"n": "\n", "t": "\t"}


class _Expr:
    """Recursive descent over the tokens of one expression; nodes are tuples."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def take(self, *values: str) -> bool:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in values:
            self.at += 1
            return True
        return False

    def next(self, kind: str) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != kind:
            raise TemplateError(f"expected a {kind}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def parse(self):
        node = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"left over: {self.tokens[self.at][1]!r}")
        return node

    def either(self):
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self):
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        node = self.joined()
        for op in ("==", "!=", "in"):
            if self.take(op):
                return (op, node, self.joined())
        return node

    def joined(self):
        node = self.filtered()
        while self.take("~", "+"):
            node = ("join", node, self.filtered())
        return node

    def filtered(self):
        node = self.atom()
        while self.take("|"):
            name = self.next("name")
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = ("filter", name, node)
        return node

    def atom(self):
        if self.take("("):
            node = self.either()
            if not self.take(")"):
                raise TemplateError("missing )")
        elif self.at < len(self.tokens) and self.tokens[self.at][0] == "str":
            node = ("const", re.sub(r"\\(.)", lambda m: _QUOTED.get(m[1], m[1]), self.next("str")[1:-1], flags=re.S))
        elif self.at < len(self.tokens) and self.tokens[self.at][0] == "int":
            node = ("const", int(self.next("int")))
        else:
            node = ("name", self.next("name"))
        while True:
            if self.take("."):
                node = ("field", node, self.next("name"))
            elif self.take("["):
                node = ("field", node, _unquoted(self.next("str")))
                if not self.take("]"):
                    raise TemplateError("missing ]")
            else:
                return node


def _unquoted(s: str) -> str:
    return s[1:-1]


def _as_text(v) -> str:
    return "" if v is None else str(v)


def evaluate(node, scope: dict):
    """The value of an expression node whose names are in scope."""
    kind = node[0]
    if kind == "const":
        return node[1]
    if kind == "name":
        return scope.get(node[1])
    if kind == "field":
        held = evaluate(node[1], scope)
        return held.get(node[2]) if isinstance(held, dict) else None
    if kind == "filter":
        return FILTERS[node[1]](_as_text(evaluate(node[2], scope)))
    if kind == "not":
        return not evaluate(node[1], scope)
    left = evaluate(node[1], scope)
    if kind == "and":
        return left and evaluate(node[2], scope)
    if kind == "or":
        return left or evaluate(node[2], scope)
    right = evaluate(node[2], scope)
    if kind == "join":
        return _as_text(left) + _as_text(right)
    if kind == "in":
        return _as_text(left) in _as_text(right)
    return left == right if kind == "==" else left != right


def fold(node):
    """The expression with every part that holds no name computed."""
    if node[0] in ("const", "name"):
        return node
    parts = tuple(fold(x) if isinstance(x, tuple) else x for x in node)
    if parts[0] in ("and", "or") and parts[1][0] == "const":
        return parts[2] if bool(parts[1][1]) == (parts[0] == "and") else parts[1]
    if all(x[0] == "const" for x in parts if isinstance(x, tuple)):
        return ("const", evaluate(parts, {}))
    if parts[0] == "join" and parts[2][0] == "const" and parts[1][0] == "join" and parts[1][2][0] == "const":
        return ("join", parts[1][1], ("const", _as_text(parts[1][2][1]) + _as_text(parts[2][1])))
    return parts


def parse(template: str) -> list:
    """The folded syntax tree: ('text', s), ('out', e), ('for', name, over, body), ('if', [(e, body)...]),
    ('set', name, e), ('generation', body)."""
    pieces = re.split(r"({{.*?}}|{%.*?%})", template, flags=re.S)
    at = 0

    def body(*ends: str):
        nonlocal at
        out: list = []
        while at < len(pieces):
            piece = pieces[at]
            at += 1
            if piece.startswith("{{"):
                e = fold(_Expr(piece[2:-2]).parse())
                out.append(("text", _as_text(e[1])) if e[0] == "const" else ("out", e))
            elif piece.startswith("{%"):
                word, _, rest = piece[2:-2].strip().partition(" ")
                if word in ends:
                    return merged(out), word, rest
                out.append(statement(word, rest))
            elif piece:
                out.append(("text", piece))
        if ends:
            raise TemplateError(f"missing {' or '.join(ends)}")
        return merged(out), "", ""

    def statement(word: str, rest: str):
        if word == "for":
            m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+messages\s*", rest)
            if not m:
                raise TemplateError("only: for NAME in messages")
            return ("for", m[1], body("endfor")[0])
        if word == "if":
            cases, test = [], rest
            while True:
                inner, ended, more = body("elif", "else", "endif")
                cases.append((fold(_Expr(test).parse()), inner))
                if ended == "elif":
                    test = more
                    continue
                if ended == "else":
                    cases.append((("const", True), body("endif")[0]))
                return ("if", cases)
        if word == "set":
            m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=(.*)", rest, flags=re.S)
            if not m:
                raise TemplateError("only: set NAME = expression")
            return ("set", m[1], fold(_Expr(m[2]).parse()))
        if word == "generation":
            return ("generation", body("endgeneration")[0])
        raise TemplateError(f"no statement {word!r}")

    def merged(nodes: list) -> list:
        out: list = []
        for node in nodes:
            if node[0] == "if" and node[1][0][0][0] == "const":                 # a test known when compiling
                taken = next((inner for test, inner in node[1] if test[0] != "const" or test[1]), [])
                if all(test[0] == "const" for test, _ in node[1]):
                    for x in taken:
                        out = merged([*out, x])
                    continue
            if node[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + node[1])
            elif node != ("text", ""):
                out.append(node)
        return out

    return body()[0]


#: A piece of output and whether it is under the loss mask; None: a message has ended.
Piece = tuple[str, bool] | None


def _closure(node, masked: bool) -> Callable[[dict, Iterator[dict]], Iterator[Piece]]:
    kind = node[0]
    if kind == "text":
        piece = (node[1], masked)
        return lambda scope, messages: iter((piece,))
    if kind == "out":
        return lambda scope, messages: iter(((_as_text(evaluate(node[1], scope)), masked),))
    if kind == "set":
        def assign(scope, messages):
            scope[node[1]] = evaluate(node[2], scope)
            return iter(())
        return assign
    if kind == "generation":
        return _sequence(node[1], True)
    if kind == "if":
        cases = [(test, _sequence(inner, masked)) for test, inner in node[1]]

        def choose(scope, messages):
            for test, inner in cases:
                if evaluate(test, scope):
                    return inner(scope, messages)
            return iter(())
        return choose
    name, inner = node[1], _sequence(node[2], masked)

    def loop(scope, messages):
        for i, message in enumerate(messages):
            scope[name] = message
            scope["loop"] = {"first": i == 0, "index": i + 1, "index0": i}
            yield from inner(scope, messages)
            yield None
    return loop


def _sequence(nodes: list, masked: bool):
    parts = [_closure(n, masked) for n in nodes]

    def run(scope, messages):
        for part in parts:
            yield from part(scope, messages)
    return run


@functools.lru_cache(maxsize=16)
def compiled(template: str) -> Callable[[Iterator[dict]], Iterator[Piece]]:
    """Messages in, pieces of output out."""
    run = _sequence(parse(template), False)
    return lambda messages: run({}, messages)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[dict]]]:
    """(id, messages) of each run of rows with one id; the messages are read as they come."""
    rows = (r for b in batches for lo in range(0, b.num_rows, 256) for r in b.slice(lo, 256).to_pylist())
    row = next(rows, None)
    while row is not None:
        key = row["conv"]

        def messages():
            nonlocal row
            while row is not None and row["conv"] == key:
                message = {"role": row["role"] or "", "text": row["text"] or "", "turn": row["turn"]}
                row = next(rows, None)
                yield message

        these = messages()
        yield key, these
        for _ in these:                       # what the template left unread
            pass


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _render(batches: Iterator[pa.RecordBatch], template: str, part_chars: int, key_type: pa.DataType):
    schema = pa.schema([("conv", key_type), ("part", pa.int64()), ("formatted", pa.string()), ("loss_spans", _SPANS)])
    rows, waiting = [], 0
    for key, messages in _conversations(batches):
        part, text, size, spans = 0, [], 0, []

        def closed():
            nonlocal part, text, size, spans, waiting
            rows.append({"conv": key, "part": part, "formatted": "".join(text), "loss_spans": spans})
            waiting += size
            part, text, size, spans = part + 1, [], 0, []

        for piece in compiled(template)(messages):
            if piece is None:
                if size >= part_chars:
                    closed()
            else:
                if piece[1]:
                    if spans and open_span and spans[-1]["end"] == size:
                        spans[-1]["end"] = size + len(piece[0])
                    else:
                        spans.append({"start": size, "end": size + len(piece[0])})
                open_span = piece[1]
                text.append(piece[0])
                size += len(piece[0])
            if waiting >= part_chars:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, waiting = [], 0
        if size or part == 0:
            closed()
        if waiting >= part_chars or len(rows) >= 1000:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows, waiting = [], 0
    yield pa.RecordBatch.from_pylist(rows, schema)


def render(df: DataFrame, template: str = CHATML, conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text", part_chars: int = 1_000_000) -> DataFrame:
    """``conv, part, formatted, loss_spans``: a conversation's output, in parts, with the spans (code points of the
    part) under the loss mask; sorted by conversation and part within its partitions."""
    compiled(template)                        # errors in the template show here
    rows = (df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"),
                      F.col(text).alias("text"))
            .repartition("conv").sortWithinPartitions("conv", "turn", "role", "text"))
    kind = df.schema[conv].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    return rows.mapInArrow(
        functools.partial(_render, template=template, part_chars=part_chars, key_type=arrow),
        f"conv {kind}, part long, formatted string, loss_spans array<struct<start long, end long>>")


_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def _read_back(batches: Iterator[pa.RecordBatch], key_type: pa.DataType):
    schema = pa.schema([("conv", key_type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    done, state = [], None

    def row():
        key, turns, digest, loss_chars, loss, chars = state
        return {"conv": key, "n_turns": turns, "turns_sha256": digest.hexdigest(), "loss_chars": loss_chars,
                "loss_sha256": loss.hexdigest(), "formatted_chars": chars}

    for batch in batches:
        for at in range(batch.num_rows):
            key, _, formatted, spans = (c[at].as_py() for c in batch.columns)
            if state is None or state[0] != key:
                if state is not None:
                    done.append(row())
                state = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            end = 0
            for m in _TURN.finditer(formatted):
                if m.start() != end:
                    raise ValueError("text between turns")
                end = m.end()
                state[1] += 1
                state[2].update(f"{unline(unescape(m[1]))}\n{unescape(m[2])}\n".encode())
            if end != len(formatted):
                raise ValueError("text after the last turn")
            for s in spans:
                text = unescape(formatted[s["start"]:s["end"]])
                state[3] += len(text)
                state[4].update(text.encode())
            state[5] += len(formatted)
        if len(done) >= 1000:
            yield pa.RecordBatch.from_pylist(done, schema)
            done = []
    if state is not None:
        done.append(row())
    yield pa.RecordBatch.from_pylist(done, schema)


def read_back(rendered: DataFrame, ordered: bool = False) -> DataFrame:
    """``conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, parsed from the output of the
    default template.  ``ordered``: the rows are as ``render`` left them, so they need no shuffle."""
    rows = rendered.select("conv", "part", "formatted", "loss_spans")
    if not ordered:
        rows = rows.repartition("conv").sortWithinPartitions("conv", "part")
    kind = rendered.schema["conv"].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    return rows.mapInArrow(
        functools.partial(_read_back, key_type=arrow),
        f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
