"""Chat formatting by compiled templates.

A small template language is parsed into a syntax tree, constants are folded,
and the tree is turned into Python closures that render a conversation and mark
the spans to train on. The language is closed: literals, the loop's message and
counters, ``+ == != and or not``, a fixed set of filters; no calls, attributes
of objects or imports, so a template cannot reach anything else.

    {% for m in messages %} ... {% endfor %}      {% if c %} ... {% elif c %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}      {{ expression | filter }}

``escape`` makes control strings inside texts harmless and is reversible: a
``<`` before ``|`` or ``\\`` gets a ``\\`` after it; ``escape_line`` also turns
a line feed into ``<\\_``. ``unescape`` takes both back.

Conversations are streamed: rows are dealt and sorted by conversation, and a
conversation longer than ``PART_CHARS`` is delivered in consecutive parts, so
no task holds a whole one. Defined cases: null text or role is empty; turns
come by ``turn`` (null first), then role and text where turns are equal, and
repeated rows stay; rows with null ``conv_id`` are one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import arrow

START, END = "<|im_start|>", "<|im_end|>"
TEMPLATE = (
    "{% for m in messages %}" + START + "{{ m.role | escape_line }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}" + END + "\n{% endfor %}"
)
PART_CHARS = 4_000_000
SCHEMA = "conv_id long, part int, n_turns long, formatted string, loss array<struct<start:int,end:int>>"


def escape(text: str) -> str:
    return re.sub(r"<(?=[|\\])", r"<\\", text)


def escape_line(text: str) -> str:
    return escape(text).replace("\n", "<\\_")


def unescape(text: str) -> str:
    return re.sub(r"<\\(_?)(?:(?<=_)|(?=[|\\]))", lambda m: "\n" if m[1] else "<", text)


FILTERS: dict[str, Callable[[str], str]] = {
    "escape": escape,
    "escape_line": escape_line,
    "trim": str.strip,
    "upper": str.upper,
    "lower": str.lower,
}


class TemplateError(ValueError):
    pass


# --- syntax tree ------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    path: tuple[str, ...]


@dataclass(frozen=True)
class Apply:
    op: str
    args: tuple


@dataclass(frozen=True)
class Put:
    value: object


@dataclass(frozen=True)
class Block:
    body: tuple


@dataclass(frozen=True)
class If:
    test: object
    yes: object
    no: object


@dataclass(frozen=True)
class For:
    var: str
    body: object


@dataclass(frozen=True)
class Generation:
    body: object


_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_][\w.]*)|(==|!=|[+|()]))")
_ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}


class _Expression:
    """Recursive descent over one expression."""

    def __init__(self, source: str, names: set[str]):
        self.items, at, self.names = [], 0, names
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.items.append(m.groups())
            at = m.end()

    def _next(self, *words: str) -> str | None:
        if self.items and (self.items[0][2] or self.items[0][3]) in words:
            got = self.items.pop(0)
            return got[2] or got[3]
        return None

    def whole(self):
        found = self._or()
        if self.items:
            raise TemplateError("text after an expression")
        return found

    def _or(self):
        left = self._and()
        while self._next("or"):
            left = fold(Apply("or", (left, self._and())))
        return left

    def _and(self):
        left = self._not()
        while self._next("and"):
            left = fold(Apply("and", (left, self._not())))
        return left

    def _not(self):
        return fold(Apply("not", (self._not(),))) if self._next("not") else self._compare()

    def _compare(self):
        left = self._sum()
        op = self._next("==", "!=")
        return fold(Apply(op, (left, self._sum()))) if op else left

    def _sum(self):
        left = self._filtered()
        while self._next("+"):
            left = fold(Apply("+", (left, self._filtered())))
        return left

    def _filtered(self):
        found = self._atom()
        while self._next("|"):
            name = self.items.pop(0)[2] if self.items else None
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            found = fold(Apply(name, (found,)))
        return found

    def _atom(self):
        if self._next("("):
            found = self._or()
            if not self._next(")"):
                raise TemplateError("a bracket is open")
            return found
        if not self.items:
            raise TemplateError("an expression is missing")
        text, number, name, sign = self.items.pop(0)
        if text is not None:
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1]))
        if number is not None:
            return Const(int(number))
        if sign is not None:
            raise TemplateError(f"unexpected {sign!r}")
        if name in ("true", "false"):
            return Const(name == "true")
        path = tuple(name.split("."))
        known = (path[0] in self.names and path[1:] in (("role",), ("text",))) or path[0] == "loop" and path[1:] in (("first",), ("last",), ("index",))
        if not known:
            raise TemplateError(f"no name {name!r}")
        return Name(path)


def _text(value: object) -> str:
    return value if isinstance(value, str) else "" if value is None else str(value)


_OPS: dict[str, Callable] = {
    "+": lambda a, b: _text(a) + _text(b),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "not": lambda a: not a,
    "and": lambda a, b: a and b,
    "or": lambda a, b: a or b,
    **{k: (lambda f: lambda a: f(_text(a)))(f) for k, f in FILTERS.items()},
}


def fold(node):
    """The node with what is constant worked out."""
    if isinstance(node, Apply) and all(isinstance(a, Const) for a in node.args):
        return Const(_OPS[node.op](*(a.value for a in node.args)))
    if isinstance(node, If) and isinstance(node.test, Const):
        return node.yes if node.test.value else node.no
    if isinstance(node, Block):
        flat: list = []
        for x in node.body:
            for y in x.body if isinstance(x, Block) else (x,):
                if isinstance(y, Put) and isinstance(y.value, Const) and flat and isinstance(flat[-1], Put) and isinstance(flat[-1].value, Const):
                    flat[-1] = Put(Const(_text(flat[-1].value.value) + _text(y.value.value)))
                elif not (isinstance(y, Put) and isinstance(y.value, Const) and not _text(y.value.value)):
                    flat.append(y)
        return Block(tuple(flat))
    return node


def parse(source: str):
    """The folded syntax tree of a template."""
    parts = re.split(r"(\{%.*?%\}|\{\{.*?\}\})", source, flags=re.S)
    parts = [p for p in parts if p]

    def block(at: int, names: set[str], until: tuple[str, ...]) -> tuple[object, int, str]:
        body: list = []
        while at < len(parts):
            p = parts[at]
            if p.startswith("{{"):
                body.append(Put(_Expression(p[2:-2], names).whole()))
                at += 1
                continue
            if not p.startswith("{%"):
                body.append(Put(Const(p)))
                at += 1
                continue
            word, _, rest = p[2:-2].strip().partition(" ")
            if word in until:
                return fold(Block(tuple(body))), at, word
            if word == "for":
                m = re.fullmatch(r"([A-Za-z_]\w*) in messages", rest.strip())
                if not m or names:
                    raise TemplateError("only one loop, over messages")
                inner, at, _ = block(at + 1, {m[1]}, ("endfor",))
                body.append(For(m[1], inner))
            elif word == "generation":
                inner, at, _ = block(at + 1, names, ("endgeneration",))
                body.append(Generation(inner))
            elif word == "if":
                found, at = branches(at, rest, names)
                body.append(found)
            else:
                raise TemplateError(f"unexpected {p}")
            at += 1
        if until:
            raise TemplateError(f"{' or '.join(until)} is missing")
        return fold(Block(tuple(body))), at, ""

    def branches(at: int, test: str, names: set[str]) -> tuple[object, int]:
        condition = _Expression(test, names).whole()
        yes, at, word = block(at + 1, names, ("elif", "else", "endif"))
        no: object = Block(())
        if word == "elif":
            no, at = branches(at, parts[at][2:-2].strip().partition(" ")[2], names)
        elif word == "else":
            no, at, _ = block(at + 1, names, ("endif",))
        return fold(If(condition, yes, no)), at

    return block(0, set(), ())[0]


# --- closures ---------------------------------------------------------------


class _Out:
    """What is rendered: pieces, their length, and the spans marked for training."""

    def __init__(self):
        self.pieces: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []
        self.turns = 0

    def put(self, text: str) -> None:
        self.pieces.append(text)
        self.length += len(text)


def _value(node) -> Callable[[dict], object]:
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):
        key = node.path[-1] if node.path[0] != "loop" else f"loop.{node.path[-1]}"
        return lambda env, k=key: env[k]
    op, args = _OPS[node.op], [_value(a) for a in node.args]
    if len(args) == 1:
        return lambda env, f=op, a=args[0]: f(a(env))
    return lambda env, f=op, a=args[0], b=args[1]: f(a(env), b(env))


Render = Callable[[dict, _Out], Iterator[None]]


def _run(node) -> Callable[[dict, _Out], None]:
    """A closure for a node without a loop."""
    if isinstance(node, Put):
        if isinstance(node.value, Const):
            return lambda env, out, t=_text(node.value.value): out.put(t)
        return lambda env, out, v=_value(node.value): out.put(_text(v(env)))
    if isinstance(node, If):
        test, yes, no = _value(node.test), _run(node.yes), _run(node.no)
        return lambda env, out: (yes if test(env) else no)(env, out)
    if isinstance(node, Generation):
        body = _run(node.body)

        def marked(env: dict, out: _Out) -> None:
            at = out.length
            body(env, out)
            if out.length > at:
                out.spans.append((at, out.length))

        return marked
    if isinstance(node, Block):
        steps = [_run(x) for x in node.body]

        def every(env: dict, out: _Out) -> None:
            for step in steps:
                step(env, out)

        return every
    raise TemplateError("a loop must stand at the top")


def compile_template(source: str) -> Callable[[Iterable[tuple[str, str]], _Out], Iterator[None]]:
    """A closure that renders ``(role, text)`` messages, and pauses after every turn."""
    steps = [(isinstance(x, For), _run(x.body if isinstance(x, For) else x)) for x in parse(source).body]

    def render(messages: Iterable[tuple[str, str]], out: _Out) -> Iterator[None]:
        for is_loop, step in steps:
            if not is_loop:
                step({}, out)
                continue
            coming, index = iter(messages), 0
            now = next(coming, None)
            while now is not None:
                after = next(coming, None)
                index += 1
                step({"role": now[0], "text": now[1], "loop.first": index == 1, "loop.last": after is None, "loop.index": index}, out)
                out.turns += 1
                yield
                now = after

    return render


def render_text(source: str, messages: Iterable[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """A whole conversation as text and training spans."""
    out = _Out()
    for _ in compile_template(source)(messages, out):
        pass
    return "".join(out.pieces), out.spans


def format_conversations(rows: DataFrame, template: str = TEMPLATE, part_chars: int = PART_CHARS) -> DataFrame:
    """Every conversation as formatted text with training spans, in parts that end with a turn."""
    parse(template)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)

        def turns() -> Iterator[tuple[int | None, str, str]]:
            for b in batches:
                yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)

        source, done = turns(), []
        row = next(source, None)

        def messages(conv: int | None) -> Iterator[tuple[str, str]]:
            nonlocal row
            while row is not None and row[0] == conv:
                yield row[1] or "", row[2] or ""
                row = next(source, None)

        held = 0
        schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

        def taken(conv: int | None, part: int, out: _Out) -> tuple:
            return conv, part, out.turns, "".join(out.pieces), [{"start": s, "end": e} for s, e in out.spans]

        while row is not None:
            conv, part, out = row[0], 0, _Out()
            for _ in render(messages(conv), out):
                if out.length >= part_chars:
                    done.append(taken(conv, part, out))
                    held += out.length
                    part += 1
                    out.__init__()
                    yield from _flush(done, schema)
            if out.length or not part:
                done.append(taken(conv, part, out))
                held += out.length
            if held >= part_chars or len(done) >= 4096:
                held = 0
                yield from _flush(done, schema)
        yield from _flush(done, schema)

    keyed = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    dealt = keyed.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return arrow.mapped(dealt.select("conv_id", "role", "text"), SCHEMA, run)


def _flush(done: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if done:
        columns = list(zip(*done, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        done.clear()


def read_back(formatted: str) -> Iterator[tuple[str, str]]:
    """The ``(role, text)`` turns of formatted text of ``TEMPLATE``."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError("a turn must begin here")
        line = formatted.index("\n", at)
        end = formatted.index(END, line)
        yield unescape(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end])
        at = end + len(END) + 1


def digests(formatted: DataFrame, as_formatted: bool = False) -> DataFrame:
    """Per conversation, what its formatted parts say: turns and text under the loss mask.

    Parts may come in any order; ``as_formatted`` spares the sort of a table that
    comes from ``format_conversations`` without a step between.
    """
    if not as_formatted:
        formatted = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        done: list[tuple] = []
        now: list | None = None

        def close() -> None:
            if now is not None:
                done.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))

        for b in batches:
            for conv, part, _, text, loss in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part == 0:
                    close()
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in read_back(text):
                    now[1] += 1
                    now[2].update(f"{role}\n{body}\n".encode())
                for span in loss:
                    body = unescape(text[span["start"] : span["end"]])
                    now[3] += len(body)
                    now[4].update(body.encode())
                now[5] += len(text)
            if len(done) >= 1024:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)

    return arrow.mapped(formatted, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long", run)
