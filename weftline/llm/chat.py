"""Chat formatting by a small template compiler.

A template is parsed into a syntax tree, constants are folded (expressions of literals, conditions
that are known, neighbouring texts) and the tree becomes Python closures that write a conversation
piece by piece. {% generation %} ... {% endgeneration %} marks what the loss covers. The language is
sandboxed: it has literals, names of the context, keys of messages, the loop's counters, operators
and the filters below, and no calls, attributes or imports.

    {{ expression }}  {% set name = expression %}  {# comment #}
    {% for m in messages %} ... {% endfor %}
    {% if a %} ... {% elif b %} ... {% else %} ... {% endif %}
    or and not  == != < <= > >= in  + ~ - * %  x if c else y  m.key  m['key']  value | filter

A "-" inside a tag's bracket strips white space on that side. Messages are read one ahead, so a
conversation of any length is formatted in the memory of two turns.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import table

#: The default template's control strings. Texts get a backslash before backslashes and before
#: the characters that control strings begin with, so that these begin control strings alone.
CONTROLS = ("[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "</s>")
TEMPLATE = """
{%- for m in messages -%}
  {%- if m.role == 'user' -%} {{ '[INST]' ~ m.text | escape ~ '[/INST]' }}
  {%- elif m.role == 'assistant' -%} {%- generation -%} {{ m.text | escape }} {%- endgeneration -%} {{ '</s>' }}
  {%- elif m.role == 'system' -%} {{ '<<SYS>>' ~ m.text | escape ~ '<</SYS>>' }}
  {%- else -%} {{ '[ROLE]' ~ m.role | escape ~ '[/ROLE]' ~ m.text | escape ~ '</s>' }}
  {%- endif -%}
{%- endfor -%}
"""


class TemplateError(ValueError):
    pass


_TAG = re.compile(r"(\{%-?.*?-?%\}|\{\{-?.*?-?\}\}|\{#.*?#\})", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~*%|.<>()\[\]=]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}
_BINARY = {
    "or": (1, lambda a, b: a or b),
    "and": (2, lambda a, b: a and b),
    "==": (4, lambda a, b: a == b),
    "!=": (4, lambda a, b: a != b),
    "<": (4, lambda a, b: a < b),
    "<=": (4, lambda a, b: a <= b),
    ">": (4, lambda a, b: a > b),
    ">=": (4, lambda a, b: a >= b),
    "in": (4, lambda a, b: a in b),
    "~": (5, lambda a, b: _text(a) + _text(b)),
    "+": (6, lambda a, b: a + b),
    "-": (6, lambda a, b: a - b),
    "*": (7, lambda a, b: _times(a, b)),
    "%": (7, lambda a, b: _remainder(a, b)),
}


def _text(value) -> str:
    return "" if value is None else {True: "true", False: "false"}[value] if isinstance(value, bool) else str(value)


def _times(a, b):
    if not all(isinstance(x, int | float) for x in (a, b)):
        raise TemplateError("* takes numbers")
    return a * b


def _remainder(a, b):
    if not all(isinstance(x, int | float) for x in (a, b)):
        raise TemplateError("% takes numbers")
    return a % b


def _filters(controls: Iterable[str]) -> dict[str, Callable]:
    special = re.compile("[" + re.escape("\\" + "".join(sorted({c[0] for c in controls}))) + "]")
    return {
        "escape": lambda x: special.sub(r"\\\g<0>", _text(x)),
        "trim": lambda x: _text(x).strip(),
        "upper": lambda x: _text(x).upper(),
        "lower": lambda x: _text(x).lower(),
        "length": len,
    }


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


class _Expression:
    """Parser of one expression; trees are tuples."""

    def __init__(self, source: str, filters: dict):
        self.source, self.filters, self.at, self.tokens = source, filters, 0, []
        at = 0
        while source[at:].strip():
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected text in {source!r}: {source[at:at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()

    def peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None):
        kind, found = self.peek()
        if kind == "end" or value is not None and found != value:
            raise TemplateError(f"expected {value or 'more'} in {self.source!r}")
        self.at += 1
        return kind, found

    def whole(self):
        tree = self.ternary()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r} in {self.source!r}")
        return tree

    def ternary(self):
        tree = self.binary(1)
        if self.peek() == ("name", "if"):
            self.take()
            condition = self.binary(1)
            self.take("else")
            tree = ("choose", condition, tree, self.ternary())
        return tree

    def binary(self, least: int):
        if self.peek() == ("name", "not"):
            self.take()
            left = ("not", self.binary(3))
        else:
            left = self.postfix()
        while (kind := self.peek())[0] in ("op", "name") and kind[1] in _BINARY and _BINARY[kind[1]][0] >= least:
            self.take()
            left = ("binary", kind[1], left, self.binary(_BINARY[kind[1]][0] + 1))
        return left

    def postfix(self):
        kind, found = self.take()
        if kind == "string":
            tree = ("constant", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), found[1:-1], flags=re.S))
        elif kind == "number":
            tree = ("constant", float(found) if "." in found else int(found))
        elif kind == "name" and found in ("true", "false", "none"):
            tree = ("constant", {"true": True, "false": False, "none": None}[found])
        elif kind == "name" and found not in _BINARY and found not in ("if", "else", "not"):
            tree = ("name", found)
        elif found == "(":
            tree = self.ternary()
            self.take(")")
        elif found == "-":
            tree = ("binary", "-", ("constant", 0), self.postfix())
        else:
            raise TemplateError(f"unexpected {found!r} in {self.source!r}")
        while self.peek()[0] == "op" and self.peek()[1] in ".[|":
            op = self.take()[1]
            if op == "[":
                tree = ("key", tree, self.ternary())
                self.take("]")
            else:
                kind, name = self.take()
                if kind != "name":
                    raise TemplateError(f"expected a name after {op} in {self.source!r}")
                if op == "|" and name not in self.filters:
                    raise TemplateError(f"no filter {name!r}")
                tree = ("key", tree, ("constant", name)) if op == "." else ("filter", name, tree)
        return tree


def _fold_expression(tree, filters):
    """The tree with every part that needs no context replaced by its value."""
    tree = tuple(_fold_expression(x, filters) if isinstance(x, tuple) else x for x in tree)
    kind = tree[0]
    known = lambda *parts: all(p[0] == "constant" for p in parts)
    if kind == "binary":
        if known(tree[2], tree[3]):
            return ("constant", _BINARY[tree[1]][1](tree[2][1], tree[3][1]))
        # (x ~ 'a') ~ 'b' has a constant tail
        if tree[1] == "~" and known(tree[3]) and tree[2][:2] == ("binary", "~") and known(tree[2][3]):
            return ("binary", "~", tree[2][2], ("constant", _text(tree[2][3][1]) + _text(tree[3][1])))
    elif kind == "not" and known(tree[1]):
        return ("constant", not tree[1][1])
    elif kind == "choose" and known(tree[1]):
        return tree[2] if tree[1][1] else tree[3]
    elif kind == "filter" and known(tree[2]):
        return ("constant", filters[tree[1]](tree[2][1]))
    return tree


def parse(source: str, filters: dict):
    """Statements of a template."""
    pieces = _TAG.split(source)
    for i in range(1, len(pieces), 2):
        if pieces[i][2:3] == "-":
            pieces[i - 1] = pieces[i - 1].rstrip()
        if pieces[i][-3:-2] == "-":
            pieces[i + 1] = pieces[i + 1].lstrip()
    stack: list[tuple[str, list, list]] = [("", [], [])]
    for i, piece in enumerate(pieces):
        body = stack[-1][1]
        if i % 2 == 0:
            if piece:
                body.append(("text", piece))
            continue
        inner = piece[2:-2].strip().removeprefix("-").removesuffix("-").strip()
        if piece.startswith("{#"):
            continue
        if piece.startswith("{{"):
            body.append(("write", _Expression(inner, filters).whole()))
            continue
        word, _, rest = inner.partition(" ")
        if word == "for":
            m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"cannot read {piece!r}")
            stack.append(("for", [], [m[1], _Expression(m[2], filters).whole()]))
        elif word == "if":
            stack.append(("if", [], [[_Expression(rest, filters).whole()]]))
        elif word in ("elif", "else") and stack[-1][0] == "if":
            kind, done, branches = stack.pop()
            branches[-1].append(done)
            branches.append([_Expression(rest, filters).whole() if word == "elif" else ("constant", True)])
            stack.append((kind, [], branches))
        elif word == "generation":
            stack.append(("generation", [], []))
        elif word == "set":
            m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=(?!=)\s*(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"cannot read {piece!r}")
            body.append(("set", m[1], _Expression(m[2], filters).whole()))
        elif word.startswith("end") and stack[-1][0] == word[3:] and word != "end":
            kind, done, extra = stack.pop()
            if kind == "if":
                extra[-1].append(done)
                stack[-1][1].append(("if", [tuple(b) for b in extra]))
            else:
                stack[-1][1].append((kind, *extra, done))
        else:
            raise TemplateError(f"unexpected {piece!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not ended")
    return stack[0][1]


def fold(body: list, filters: dict) -> list:
    """The statements with constants computed, settled branches chosen and neighbouring texts joined."""
    out: list = []

    def add(x):
        if x[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + x[1])
        elif x != ("text", ""):
            out.append(x)

    for x in body:
        if x[0] == "write":
            tree = _fold_expression(x[1], filters)
            add(("text", _text(tree[1])) if tree[0] == "constant" else ("write", tree))
        elif x[0] == "set":
            out.append(("set", x[1], _fold_expression(x[2], filters)))
        elif x[0] == "for":
            out.append(("for", x[1], _fold_expression(x[2], filters), fold(x[3], filters)))
        elif x[0] == "generation":
            out.append(("generation", fold(x[1], filters)))
        elif x[0] == "if":
            left = []
            for condition, inner in x[1]:
                condition = _fold_expression(condition, filters)
                if condition[0] == "constant" and not condition[1]:
                    continue
                left.append((condition, fold(inner, filters)))
                if condition[0] == "constant":
                    break
            if left and left[0][0][0] == "constant":
                for y in left[0][1]:
                    add(y)
            elif left:
                out.append(("if", left))
        else:
            add(x)
    return out


def _value(tree, filters) -> Callable[[dict], object]:
    kind = tree[0]
    if kind == "constant":
        return lambda env, v=tree[1]: v
    if kind == "name":

        def name(env, n=tree[1]):
            if n not in env:
                raise TemplateError(f"no name {n!r}")
            return env[n]

        return name
    if kind == "key":
        inner, key = _value(tree[1], filters), _value(tree[2], filters)

        def look(env):
            value, k = inner(env), key(env)
            return value.get(k) if isinstance(value, dict) else value[k] if isinstance(value, str | list) and isinstance(k, int) else _refuse(k)

        return look
    if kind == "filter":
        f, inner = filters[tree[1]], _value(tree[2], filters)
        return lambda env: f(inner(env))
    if kind == "not":
        inner = _value(tree[1], filters)
        return lambda env: not inner(env)
    if kind == "choose":
        c, a, b = (_value(t, filters) for t in tree[1:])
        return lambda env: a(env) if c(env) else b(env)
    op, a, b = _BINARY[tree[1]][1], _value(tree[2], filters), _value(tree[3], filters)
    if tree[1] == "and":
        return lambda env: a(env) and b(env)
    if tree[1] == "or":
        return lambda env: a(env) or b(env)
    return lambda env: op(a(env), b(env))


def _refuse(key):
    raise TemplateError(f"no key {key!r}")


def _body(body: list, filters: dict, masked: bool) -> Callable:
    steps = [_step(x, filters, masked) for x in body]

    def run(env, write):
        for s in steps:
            s(env, write)

    return steps[0] if len(steps) == 1 else run


def _step(x, filters: dict, masked: bool) -> Callable:
    kind = x[0]
    if kind == "text":
        return lambda env, write, t=x[1]: write(t, masked)
    if kind == "write":
        value = _value(x[1], filters)
        return lambda env, write: write(_text(value(env)), masked)
    if kind == "set":
        value = _value(x[2], filters)

        def put(env, write, n=x[1]):
            env[n] = value(env)

        return put
    if kind == "generation":
        return _body(x[1], filters, True)
    if kind == "if":
        branches = [(_value(c, filters), _body(b, filters, masked)) for c, b in x[1]]

        def choose(env, write):
            for c, b in branches:
                if c(env):
                    return b(env, write)

        return choose
    name, many, inner = x[1], _value(x[2], filters), _body(x[3], filters, masked)

    def loop(env, write):
        before = env.get("loop")
        rows = iter(many(env))
        row = next(rows, loop)
        i = 0
        while row is not loop:
            after = next(rows, loop)
            env[name] = row
            env["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": after is loop}
            inner(env, write)
            row, i = after, i + 1
        env["loop"] = before

    return loop


class Template:
    """A compiled template. render() passes its output to write(text, under the loss)."""

    def __init__(self, source: str = TEMPLATE, controls: Iterable[str] = CONTROLS):
        filters = _filters(controls)
        self.tree = fold(parse(source, filters), filters)
        self.run = _body(self.tree, filters, False)

    def render(self, messages: Iterable[dict], write: Callable[[str, bool], None], **context) -> None:
        self.run({**context, "messages": messages}, write)

    def text(self, messages: Iterable[dict], **context) -> tuple[str, list[tuple[int, int]]]:
        """The formatted conversation and the spans, in code points, that the loss covers."""
        pieces, spans, at = [], [], 0

        def write(piece, masked):
            nonlocal at
            pieces.append(piece)
            if masked and piece:
                spans.append((at, at + len(piece)))
            at += len(piece)

        self.render(messages, write, **context)
        return "".join(pieces), spans


#: Text in which control characters are escaped, then each kind of turn in the default template's output.
_ESCAPED = r"((?:[^\\\[<]++|\\.)*+)"
_TURN = re.compile(rf"\[INST\]{_ESCAPED}\[/INST\]|<<SYS>>{_ESCAPED}<</SYS>>|\[ROLE\]{_ESCAPED}\[/ROLE\]{_ESCAPED}</s>|{_ESCAPED}</s>", re.S)


class Reader:
    """Reads the turns back from the default template's output, as it comes."""

    def __init__(self, turn: Callable[[str, str], None]):
        self.turn, self.held = turn, []

    def feed(self, piece: str) -> None:
        self.held.append(piece)
        if not piece.endswith((">", "]")):
            return
        rest, at = "".join(self.held), 0
        while m := _TURN.match(rest, at):
            user, system, role, text, assistant = m.groups()
            if user is not None:
                self.turn("user", unescape(user))
            elif system is not None:
                self.turn("system", unescape(system))
            elif role is not None:
                self.turn(unescape(role), unescape(text))
            else:
                self.turn("assistant", unescape(assistant))
            at = m.end()
        self.held = [rest[at:]] if at < len(rest) else []

    def close(self) -> None:
        if "".join(self.held):
            raise ValueError("output that no turn explains")


def _conversations(batches, turns: int = 512):
    """(id, messages) of rows that come sorted; messages are read as they are used."""

    def rows():
        for batch in batches:
            for begin in range(0, batch.num_rows, turns):
                part = batch.slice(begin, turns)
                yield from zip(*(part.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True)

    for conv, group in itertools.groupby(rows(), key=lambda r: r[0]):
        yield conv, ({"role": r[1] or "", "text": r[2] or ""} for r in group)


def _sorted(conversations: DataFrame, id_column: str) -> DataFrame:
    """Rows of a conversation in one partition, in order; the sort spills, so none is held in memory."""
    rows = conversations.select(F.col(id_column).alias("conv_id"), F.col("turn"), F.col("role"), F.col("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def format_chats(conversations: DataFrame, template: str = TEMPLATE, controls: Iterable[str] = CONTROLS, id_column: str = "conv_id") -> DataFrame:
    """(id, formatted, loss array<struct<begin, end>>): one row per conversation.

    Turns come by turn, then role and text where turns tie; null turns first. Null roles and texts
    count as empty, rows with a null id are one conversation, repeated rows are repeated turns, an
    empty table gives an empty result and other columns are ignored. Roles other than user, assistant
    and system are written with their name.
    """
    kind = conversations.schema[id_column].dataType.simpleString()
    controls = tuple(controls)

    def run(batches):
        compiled = Template(template, controls)
        for conv, messages in _conversations(batches):
            text, spans = compiled.text(messages)
            loss = [{"begin": a, "end": b} for a, b in spans]
            yield pa.RecordBatch.from_arrays([pa.array([conv], to_arrow), pa.array([text], pa.string()), pa.array([loss], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))], [id_column, "formatted", "loss"])

    from pyspark.sql.pandas.types import to_arrow_type

    to_arrow = to_arrow_type(conversations.schema[id_column].dataType)
    return _sorted(conversations, id_column).mapInArrow(run, f"`{id_column}` {kind}, formatted string, loss array<struct<begin: bigint, end: bigint>>")


def digest(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the output.

    A conversation is written, read and hashed as a stream, so it may have any number of turns. Cases
    as in format_chats().
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        compiled, rows = Template(), []
        for conv, messages in _conversations(batches):
            turns, loss, counts = hashlib.sha256(), hashlib.sha256(), np.zeros(3, np.int64)

            def turn(role, text, turns=turns, counts=counts):
                turns.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
                counts[0] += 1

            reader = Reader(turn)

            def write(piece, masked, loss=loss, counts=counts, reader=reader):
                counts[2] += len(piece)
                if masked:
                    plain = unescape(piece)
                    loss.update(plain.encode("utf-8", "replace"))
                    counts[1] += len(plain)
                reader.feed(piece)

            compiled.render(messages, write)
            reader.close()
            rows.append((conv, int(counts[0]), turns.hexdigest(), int(counts[1]), loss.hexdigest(), int(counts[2])))
            if len(rows) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return _sorted(conversations, "conv_id").mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql("select * from values (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)")
    return digest(rows.union(probe))


_KEY = "order by turn nulls first, role nulls first, text nulls first"
ORACLE = rf"""
with rows as (select conv_id, turn, role, text from conversations union all
 values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from rows)
select conv_id, count(*) as n_turns,
 sha256(string_agg(role || chr(10) || text || chr(10), '' {_KEY})) as turns_sha256,
 coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
 sha256(coalesce(string_agg(text, '' {_KEY}) filter (role = 'assistant'), '')) as loss_sha256,
 sum(length(regexp_replace(text, '([\\\[<])', '\\\1', 'g')) + case role when 'user' then 13 when 'system' then 15 when 'assistant' then 4
  else 17 + length(regexp_replace(role, '([\\\[<])', '\\\1', 'g')) end)::bigint as formatted_chars
from c group by conv_id
"""
