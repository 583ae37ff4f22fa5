"""Operator 8: chat formatting by a template compiler.

The template language is a sandboxed subset of the usual chat templates:

    {{ expr }}   {% for m in messages %} ... {% endfor %}   {% if expr %} ... {% elif expr %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}        text under the loss mask
    expr:  'text', numbers, true/false, names, m.role, m.text, == != and or not, +, ( ), | filter
    filters: trim, upper, lower, escape, escape_line

There is no call, subscript, import or attribute beyond a turn's fields, so a template can't reach Python.
A template is parsed into a syntax tree, constants are folded, and the tree becomes nested Python closures.

Rows are rendered turn by turn: the loop body's closure is applied to each turn where Spark has put it, so a
conversation of any length is never gathered.  Output rows carry the formatted piece and its masked spans.

Control strings in texts are escaped reversibly: ``<`` plus n backslashes plus ``|`` gets one backslash more.

Edge cases: null roles and texts are empty; turns of equal number are ordered by role and text, repeated rows stay;
a null conv_id is a conversation of its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

CHATML = (
    "{% for m in messages %}<|im_start|>{{ m.role | escape_line }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}<|im_end|>\n{% endfor %}"
)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_line(text: str) -> str:
    """As :func:`escape`, and on one line."""
    return escape(text.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_line(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text), flags=re.S)


FILTERS: dict[str, Callable[[str], str]] = {"trim": str.strip, "upper": str.upper, "lower": str.lower, "escape": escape, "escape_line": escape_line}
FIELDS = ("role", "text")


class TemplateError(ValueError):
    """The template is not of the language."""


@dataclass
class Node:
    """kind: text, const, name, field, filter, binary, not, out, if, for, generation, block."""

    kind: str
    value: object = None
    parts: list[Node] = field(default_factory=list)


TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[|+().]))")


class Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.strip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:at + 10]!r}")
            self.tokens.append(m.group(0).strip())
            at = m.end()

    def peek(self) -> str:
        return self.tokens[0] if self.tokens else ""

    def next(self, *wanted: str) -> str:
        if not self.tokens or wanted and self.tokens[0] not in wanted:
            raise TemplateError(f"expected {wanted or 'a value'}, found {self.peek()!r}")
        return self.tokens.pop(0)

    def whole(self) -> Node:
        node = self.either()
        if self.tokens:
            raise TemplateError(f"unexpected {self.peek()!r}")
        return node

    def either(self) -> Node:
        return self._chain(("or",), self.both)

    def both(self) -> Node:
        return self._chain(("and",), self.negated)

    def negated(self) -> Node:
        if self.peek() == "not":
            self.next()
            return Node("not", parts=[self.negated()])
        return self._chain(("==", "!="), self.added)

    def added(self) -> Node:
        return self._chain(("+",), self.filtered)

    def _chain(self, ops: tuple[str, ...], below: Callable[[], Node]) -> Node:
        node = below()
        while self.peek() in ops:
            node = Node("binary", self.next(), [node, below()])
        return node

    def filtered(self) -> Node:
        node = self.atom()
        while self.peek() == "|":
            self.next()
            name = self.next()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = Node("filter", name, [node])
        return node

    def atom(self) -> Node:
        t = self.next()
        if t == "(":
            node = self.either()
            self.next(")")
            return node
        if t[0] in "'\"":
            return Node("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), t[1:-1]))
        if t.isdigit():
            return Node("const", int(t))
        if t in ("true", "false"):
            return Node("const", t == "true")
        if not t.isidentifier():
            raise TemplateError(f"unexpected {t!r}")
        if self.peek() == ".":
            self.next()
            name = self.next()
            if name not in FIELDS:
                raise TemplateError(f"a turn has no field {name!r}")
            return Node("field", (t, name))
        return Node("name", t)


def parse(source: str) -> Node:
    """The syntax tree of a template."""
    pieces = [p for p in re.split(r"(\{%.*?%\}|\{\{.*?\}\})", source, flags=re.S) if p]

    def block(ends: tuple[str, ...]) -> tuple[Node, str]:
        node = Node("block")
        while pieces:
            piece = pieces.pop(0)
            if piece.startswith("{{"):
                node.parts.append(Node("out", parts=[Expression(piece[2:-2]).whole()]))
            elif piece.startswith("{%"):
                tag = piece[2:-2].strip()
                word, _, rest = tag.partition(" ")
                if word in ends:
                    return node, tag
                if word == "for":
                    m = re.fullmatch(r"(\w+)\s+in\s+messages", rest.strip())
                    if not m:
                        raise TemplateError(f"a loop is `for name in messages`: {tag!r}")
                    node.parts.append(Node("for", m[1], [block(("endfor",))[0]]))
                elif word == "generation":
                    node.parts.append(Node("generation", parts=[block(("endgeneration",))[0]]))
                elif word == "if":
                    node.parts.append(branch(rest))
                else:
                    raise TemplateError(f"unknown tag {tag!r}")
            else:
                node.parts.append(Node("text", piece))
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return node, ""

    def branch(test: str) -> Node:
        then, tag = block(("elif", "else", "endif"))
        word, _, rest = tag.partition(" ")
        other = branch(rest) if word == "elif" else block(("endif",))[0] if word == "else" else Node("block")
        return Node("if", parts=[Expression(test).whole(), then, other])

    return block(())[0]


def fold(node: Node) -> Node:
    """Constants folded: operators and filters on constants, branches with constant tests, runs of text."""
    parts = [fold(p) for p in node.parts]
    const = all(p.kind == "const" for p in parts)
    if node.kind == "filter" and const:
        return Node("const", FILTERS[node.value](str(parts[0].value)))
    if node.kind == "not" and const:
        return Node("const", not parts[0].value)
    if node.kind == "binary" and const:
        return Node("const", _binary(node.value, lambda _: parts[0].value, lambda _: parts[1].value)(None))
    if node.kind == "out" and const:
        return Node("text", str(parts[0].value))
    if node.kind == "if" and parts[0].kind == "const":
        return parts[1] if parts[0].value else parts[2]
    if node.kind == "block":
        flat: list[Node] = []
        for p in parts:
            for q in p.parts if p.kind == "block" else [p]:
                if q.kind == "text" and flat and flat[-1].kind == "text":
                    flat[-1] = Node("text", flat[-1].value + q.value)
                else:
                    flat.append(q)
        parts = flat
    return Node(node.kind, node.value, parts)


def _binary(op: str, a: Callable, b: Callable) -> Callable:
    return {
        "==": lambda env: a(env) == b(env),
        "!=": lambda env: a(env) != b(env),
        "and": lambda env: a(env) and b(env),
        "or": lambda env: a(env) or b(env),
        "+": lambda env: str(a(env)) + str(b(env)),
    }[op]


def value(node: Node) -> Callable[[dict], object]:
    """The closure of an expression."""
    parts = [value(p) for p in node.parts]
    if node.kind == "const":
        return lambda env, c=node.value: c
    if node.kind == "field":
        name, key = node.value
        return lambda env: env[name][key]
    if node.kind == "name":
        return lambda env, name=node.value: env.get(name, "")
    if node.kind == "filter":
        return lambda env, f=FILTERS[node.value], a=parts[0]: f(str(a(env)))
    if node.kind == "not":
        return lambda env, a=parts[0]: not a(env)
    return _binary(node.value, *parts)


class Output:
    """Formatted text and its masked (start, end) spans, in code points."""

    def __init__(self):
        self.pieces: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.pieces.append(text)
        self.size += len(text)


def statement(node: Node) -> Callable[[dict, Output], None]:
    """The closure of a statement."""
    if node.kind == "text":
        return lambda env, out, t=node.value: out.write(t)
    if node.kind == "out":
        return lambda env, out, v=value(node.parts[0]): out.write(str(v(env)))
    if node.kind == "if":
        test, then, other = value(node.parts[0]), *map(statement, node.parts[1:])
        return lambda env, out: (then if test(env) else other)(env, out)
    parts = [statement(p) for p in node.parts]
    if node.kind == "generation":

        def masked(env: dict, out: Output, body=parts[0]) -> None:
            start = out.size
            body(env, out)
            out.spans.append((start, out.size))

        return masked
    if node.kind == "for":

        def loop(env: dict, out: Output, body=parts[0], name=node.value) -> None:
            for m in env["messages"]:
                body(env | {name: m}, out)

        return loop

    def run(env: dict, out: Output) -> None:
        for p in parts:
            p(env, out)

    return run


class Template:
    """A compiled template."""

    def __init__(self, source: str):
        self.tree = fold(parse(source))
        self.run = statement(self.tree)
        loops = [i for i, p in enumerate(self.tree.parts) if p.kind == "for"]
        #: The template is one loop over the turns, so that turns may be rendered apart.
        self.by_turn = len(self.tree.parts) == 1 and loops == [0]

    def render(self, messages: list[dict[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """The formatted conversation and its masked spans."""
        out = Output()
        self.run({"messages": messages}, out)
        return "".join(out.pieces), out.spans


FORMATTED = "conv_id long, turn long, formatted string, mask array<struct<start:long,end:long>>"


def format_conversations(
    conversations: DataFrame, template: str = CHATML, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per turn, ``FORMATTED``: a conversation's text is its pieces in order of turn, with nothing between."""
    if not Template(template).by_turn:
        raise TemplateError("a template applied to tables is one loop over the messages")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = Template(template).render
        for batch in batches:
            made = [render([{"role": r or "", "text": t or ""}]) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            masks = [[{"start": a, "end": b} for a, b in m] for _, m in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in made], pa.string()), pa.array(masks, span)], names=["conv_id", "turn", "formatted", "mask"])

    rows = conversations.selectExpr(f"cast(`{conv_col}` as long) as conv_id", f"cast(`{turn_col}` as long) as turn", f"`{role_col}` as role", f"`{text_col}` as text")
    return rows.mapInArrow(run, FORMATTED)


TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """``DIGEST`` of each conversation, read from formatted rows of the default template.  Rows are sorted by
    conversation and streamed: a task holds one turn and the running digests of one conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        conv, n, turns, chars, loss, size = None, 0, hashlib.sha256(), 0, hashlib.sha256(), 0

        def flush() -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            cols = list(zip(*done, strict=True)) if done else [()] * 6
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[c.split()[0] for c in DIGEST.split(", ")])

        for batch in batches:
            for conv_id, text, mask in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if n and conv_id != conv:
                    done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))
                    n, turns, chars, loss, size = 0, hashlib.sha256(), 0, hashlib.sha256(), 0
                conv = conv_id
                for m in TURN.finditer(text):
                    n += 1
                    turns.update(f"{unescape_line(m[1])}\n{unescape(m[2])}\n".encode())
                for span in mask:
                    part = unescape(text[span["start"] : span["end"]])
                    chars += len(part)
                    loss.update(part.encode())
                size += len(text)
            yield flush()
        if n:
            done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))
            yield flush()

    # The formatted text starts with role and text, which orders turns of equal number.
    ordered = formatted.select("conv_id", "turn", "formatted", "mask").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return ordered.mapInArrow(run, DIGEST)
