"""Expression text to a tree of nodes."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from tidegauge.functions.timegrid import UNITS, duration


class ParseError(ValueError):
    """The text is no expression of the language."""


@dataclass(frozen=True)
class Matcher:
    name: str
    op: str
    value: str


@dataclass(frozen=True)
class Number:
    value: float


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Selector:
    matchers: tuple[Matcher, ...]
    offset: int = 0
    at: int | str | None = None


@dataclass(frozen=True)
class Matrix:
    """A range of a selector or, with a resolution (0: the query's step), a subquery of any expression."""

    of: object
    width: int
    resolution: int | None = None
    offset: int = 0
    at: int | str | None = None


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Aggregate:
    op: str
    args: tuple
    labels: tuple[str, ...] = ()
    without: bool = False


@dataclass(frozen=True)
class Negative:
    of: object


@dataclass(frozen=True)
class Matching:
    labels: tuple[str, ...] = ()
    on: bool = False
    group: str = ""
    include: tuple[str, ...] = ()


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object
    as_bool: bool = False
    matching: Matching = field(default_factory=Matching)


# The language's words and the strength of its binary operators.
AGGREGATES = frozenset({"sum", "avg", "min", "max", "count", "group", "stddev", "stdvar", "quantile", "topk", "bottomk", "count_values"})
STRENGTH = {"or": 1, "and": 2, "unless": 2, "==": 3, "!=": 3, ">": 3, "<": 3, ">=": 3, "<=": 3, "+": 4, "-": 4, "*": 5, "/": 5, "%": 5, "atan2": 5, "^": 6}
COMPARISONS = frozenset({"==", "!=", ">", "<", ">=", "<="})
SETS = frozenset({"and", "or", "unless"})
_UNIT = "|".join(sorted(UNITS, key=len, reverse=True))
_TOKEN = re.compile(
    rf"""\s+|\#[^\n]*
    |(?P<duration>(?:[0-9]+(?:{_UNIT}))+(?![A-Za-z0-9_]))
    |(?P<number>0x[0-9a-fA-F]+|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)
    |(?P<name>(?:[A-Za-z_]|:(?=[A-Za-z_:]))[A-Za-z0-9_:]*)
    |(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`[^`]*`)
    |(?P<op>=~|!~|==|!=|>=|<=|[-+*/%^=<>(){{}}\[\],:@])""",
    re.VERBOSE,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _unquote(raw: str) -> str:
    return raw[1:-1] if raw[0] == "`" else re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), raw[1:-1])


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ParseError(f"unexpected {text[at : at + 20]!r}")
        if m.lastgroup:
            out.append((m.lastgroup, m[0]))
        at = m.end()
    return [*out, ("end", "")]


class _Parser:
    def __init__(self, text: str) -> None:
        self.tokens, self.at = _tokens(text), 0

    def peek(self, *texts: str) -> bool:
        return self.tokens[self.at][1] in texts and self.tokens[self.at][0] not in ("string", "end")

    def take(self, *texts: str) -> str | None:
        if not self.peek(*texts):
            return None
        self.at += 1
        return self.tokens[self.at - 1][1]

    def need(self, kind: str, text: str | None = None) -> str:
        found, value = self.tokens[self.at]
        if found != kind or (text is not None and value != text):
            raise ParseError(f"{text or kind} wanted at {value!r}")
        self.at += 1
        return value

    def expression(self, least: int = 1) -> object:
        left = self.unary()
        while (op := self.tokens[self.at][1]) in STRENGTH and self.tokens[self.at][0] in ("op", "name") and STRENGTH[op] >= least:
            self.at += 1
            as_bool = self.take("bool") is not None
            if as_bool and op not in COMPARISONS:
                raise ParseError(f"bool goes with comparisons, not with {op}")
            matching = self.matching()
            right = self.expression(STRENGTH[op] + (op != "^"))
            left = Binary(op, left, right, as_bool, matching)
        return left

    def matching(self) -> Matching:
        word = self.take("on", "ignoring")
        labels = self.names() if word else ()
        group = self.take("group_left", "group_right") or ""
        include = self.names() if group and self.peek("(") else ()
        return Matching(labels, word == "on", group, include)

    def names(self) -> tuple[str, ...]:
        self.need("op", "(")
        out = []
        while not self.take(")"):
            out.append(self.need("name"))
            if not self.take(",") and not self.peek(")"):
                raise ParseError("a list of labels is not closed")
        return tuple(out)

    def unary(self) -> object:
        if self.take("-"):
            return Negative(self.expression(STRENGTH["^"]))
        if self.take("+"):
            return self.expression(STRENGTH["^"])
        return self.postfix(self.primary())

    def postfix(self, node: object) -> object:
        while True:
            if self.take("["):
                width, resolution = duration(self.need("duration")), None
                if self.take(":"):
                    resolution = duration(self.need("duration")) if self.tokens[self.at][0] == "duration" else 0
                elif not isinstance(node, Selector):
                    raise ParseError("a range stands after a selector; a subquery needs a colon")
                self.need("op", "]")
                node = Matrix(node, width, resolution)
            elif self.take("offset"):
                sign = -1 if self.take("-") else 1
                node = self.shifted(node, offset=sign * duration(self.need("duration")))
            elif self.take("@"):
                node = self.shifted(node, at=self.time())
            else:
                return node

    def time(self) -> int | str:
        if word := self.take("start", "end"):
            self.need("op", "(")
            self.need("op", ")")
            return word
        sign = -1 if self.take("-") else 1
        return round(sign * float(self.need("number")) * 1000)

    @staticmethod
    def shifted(node: object, **change: object) -> object:
        if not isinstance(node, Selector | Matrix):
            raise ParseError("offset and @ stand after a selector or a subquery")
        return replace(node, **change)

    def primary(self) -> object:
        kind, value = self.tokens[self.at]
        if kind == "number":
            self.at += 1
            return Number(float(int(value, 16)) if value[:2] == "0x" else float(value))
        if kind == "string":
            self.at += 1
            return Text(_unquote(value))
        if self.take("("):
            node = self.expression()
            self.need("op", ")")
            return node
        if self.peek("{"):
            return self.selector("")
        if kind != "name":
            raise ParseError(f"an expression is wanted at {value!r}")
        self.at += 1
        if value.lower() in ("inf", "nan"):
            return Number(float(value))
        if value in AGGREGATES and self.peek("(", "by", "without"):
            return self.aggregate(value)
        return Call(value, self.arguments()) if self.peek("(") else self.selector(value)

    def arguments(self) -> tuple:
        self.need("op", "(")
        out = []
        while not self.take(")"):
            out.append(self.expression())
            if not self.take(",") and not self.peek(")"):
                raise ParseError("arguments are not closed")
        return tuple(out)

    def aggregate(self, op: str) -> Aggregate:
        word = self.take("by", "without")
        labels = self.names() if word else ()
        args = self.arguments()
        if not word and (word := self.take("by", "without")):
            labels = self.names()
        return Aggregate(op, args, labels, word == "without")

    def selector(self, name: str) -> Selector:
        found = [Matcher("__name__", "=", name)] if name else []
        if self.take("{"):
            while not self.take("}"):
                label = self.need("name")
                op = self.take("=", "!=", "=~", "!~")
                if not op:
                    raise ParseError(f"a matcher is wanted after {label!r}")
                found.append(Matcher(label, op, _unquote(self.need("string"))))
                if not self.take(",") and not self.peek("}"):
                    raise ParseError("matchers are not closed")
        if all(m.value == "" and m.op in ("=", "=~") for m in found):
            raise ParseError("a selector needs a matcher that an empty label does not meet")
        return Selector(tuple(found))


def parse(text: str) -> object:
    parser = _Parser(text)
    node = parser.expression()
    parser.need("end")
    return node


def walk(node: object) -> list[object]:
    """The node and all below it, outermost first."""
    below = {Matrix: lambda n: [n.of], Call: lambda n: n.args, Aggregate: lambda n: n.args, Negative: lambda n: [n.of], Binary: lambda n: [n.left, n.right]}
    return [node, *(x for child in below.get(type(node), lambda n: [])(node) for x in walk(child))]
