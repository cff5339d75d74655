"""Query text to a syntax tree: one regular expression for tokens, precedence climbing for expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields, is_dataclass

from .durations import DurationError, parse_duration

AGGREGATIONS = ("sum", "avg", "min", "max", "count", "stddev", "stdvar", "topk", "bottomk", "quantile", "count_values", "group")
PARAMETRIC = ("topk", "bottomk", "quantile", "count_values")
COMPARISONS = ("==", "!=", ">", "<", ">=", "<=")
SETS = ("and", "or", "unless")
#: From loosest to tightest; ^ associates to the right. Unary signs bind tighter than ^, so -2^2 is 4.
LEVELS = [("or",), ("and", "unless"), COMPARISONS, ("+", "-"), ("*", "/", "%"), ("^",)]


class QuerySyntaxError(ValueError):
    """A text that is not a query."""


@dataclass(frozen=True)
class Matcher:
    label: str
    op: str
    value: str

    def __str__(self) -> str:
        return f"{self.label}{self.op}{quote(self.value)}"


@dataclass(frozen=True)
class Number:
    value: float

    def __str__(self) -> str:
        return f"{self.value:g}"


@dataclass(frozen=True)
class Text:
    value: str

    def __str__(self) -> str:
        return quote(self.value)


@dataclass(frozen=True)
class Selector:
    """An instant selector, or a range selector if window is given."""

    name: str | None
    matchers: tuple[Matcher, ...] = ()
    window: int | None = None
    offset: int = 0
    at: float | str | None = None

    def __str__(self) -> str:
        inner = ",".join(map(str, self.matchers))
        return (self.name or "") + (f"{{{inner}}}" if inner or not self.name else "") + (f"[{self.window}s]" if self.window is not None else "") + _tail(self)


@dataclass(frozen=True)
class Subquery:
    of: object
    window: int
    step: int | None
    offset: int = 0
    at: float | str | None = None

    def __str__(self) -> str:
        return f"{self.of}[{self.window}s:{'' if self.step is None else f'{self.step}s'}]" + _tail(self)


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple = ()

    def __str__(self) -> str:
        return f"{self.name}({', '.join(map(str, self.args))})"


@dataclass(frozen=True)
class Aggregate:
    op: str
    of: object
    parameter: object = None
    labels: tuple[str, ...] = ()
    without: bool = False

    def __str__(self) -> str:
        by = f" {'without' if self.without else 'by'} ({', '.join(self.labels)})" if self.labels or self.without else ""
        return f"{self.op}{by}({'' if self.parameter is None else f'{self.parameter}, '}{self.of})"


@dataclass(frozen=True)
class Matching:
    """How operands pair: on (or ignoring) labels; many is the side with many, include what its rows take along."""

    on: bool = False
    labels: tuple[str, ...] = ()
    many: str | None = None
    include: tuple[str, ...] = ()

    def __str__(self) -> str:
        own = f" {'on' if self.on else 'ignoring'} ({', '.join(self.labels)})" if self.on or self.labels else ""
        return own + (f" group_{self.many} ({', '.join(self.include)})" if self.many else "")


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object
    bool_: bool = False
    matching: Matching = field(default_factory=Matching)

    def __str__(self) -> str:
        return f"({self.left} {self.op}{' bool' * self.bool_}{self.matching} {self.right})"


@dataclass(frozen=True)
class Negate:
    of: object

    def __str__(self) -> str:
        return f"-{self.of}"


def quote(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r") + '"'


def _tail(node) -> str:
    return (f" offset {node.offset}s" if node.offset else "") + ("" if node.at is None else f" @ {node.at}{'()' * isinstance(node.at, str)}")


def walk(node) -> Iterator:
    """The node and all below it, parents first."""
    yield node
    for f in fields(node) if is_dataclass(node) else ():
        value = getattr(node, f.name)
        for child in value if isinstance(value, tuple) else (value,):
            if is_dataclass(child):
                yield from walk(child)


def rewrite(node, change: Callable):
    """The tree with change applied from the leaves up."""
    if isinstance(node, tuple):
        return tuple(rewrite(x, change) for x in node)
    if not is_dataclass(node):
        return node
    return change(type(node)(**{f.name: rewrite(getattr(node, f.name), change) for f in fields(node)}))


_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)
      |(?P<duration>(?:\d+(?:\.\d+)?(?:ms|[smhdwy]))+(?![\w.]))
      |(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
      |(?P<word>[^\W\d][\w.:]*)
      |(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`[^`]*`)
      |(?P<symbol>=~|!~|==|!=|>=|<=|[-+*/%^<>=(){}\[\],:@])""",
    re.X | re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int


def tokenize(query: str) -> list[Token]:
    out, at = [], 0
    while at < len(query):
        match = _TOKEN.match(query, at)
        if not match:
            raise QuerySyntaxError(f"unexpected {query[at]!r} at {at}")
        if match.lastgroup != "skip":
            out.append(Token(match.lastgroup, match[0], at))
        at = match.end()
    return [*out, Token("end", "", len(query))]


def _unquote(text: str) -> str:
    return text[1:-1] if text[0] == "`" else re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S)


class _Parser:
    def __init__(self, query: str):
        self.tokens, self.k = tokenize(query), 0

    @property
    def now(self) -> Token:
        return self.tokens[self.k]

    def is_(self, *texts: str) -> bool:
        return self.now.kind in ("symbol", "word") and self.now.text in texts

    def word(self, *texts: str) -> bool:
        return self.now.kind == "word" and self.now.text.lower() in texts

    def take(self) -> Token:
        self.k += 1
        return self.tokens[self.k - 1]

    def accept(self, text: str) -> bool:
        if self.is_(text):
            self.k += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.accept(text):
            raise QuerySyntaxError(f"expected {text!r} instead of {self.now.text or 'the end'!r} at {self.now.at}")

    def expression(self, level: int = 0):
        if level == len(LEVELS):
            return self.unary()
        left = self.expression(level + 1)
        while (self.now.kind == "symbol" and self.now.text in LEVELS[level]) or self.word(*LEVELS[level]):
            op = self.take().text.lower()
            bool_ = self.word("bool")
            if bool_:
                if op not in COMPARISONS:
                    raise QuerySyntaxError("bool goes with comparisons only")
                self.take()
            matching = self.matching()
            right = self.expression(level if op == "^" else level + 1)
            left = Binary(op, left, right, bool_, matching)
        return left

    def matching(self) -> Matching:
        on, labels, many, include = False, (), None, ()
        if self.word("on", "ignoring"):
            on = self.take().text.lower() == "on"
            labels = self.names()
        if self.word("group_left", "group_right"):
            many = self.take().text.lower().removeprefix("group_")
            include = self.names() if self.is_("(") else ()
        return Matching(on, labels, many, include)

    def names(self) -> tuple[str, ...]:
        self.need("(")
        out = []
        while not self.accept(")"):
            if self.now.kind != "word":
                raise QuerySyntaxError(f"expected a label at {self.now.at}")
            out.append(self.take().text)
            if not self.accept(","):
                self.need(")")
                break
        return tuple(out)

    def unary(self):
        if self.accept("-"):
            of = self.unary()
            return Number(-of.value) if isinstance(of, Number) else Negate(of)
        if self.accept("+"):
            return self.unary()
        return self.postfix(self.primary())

    def duration(self) -> int:
        token = self.take()
        if token.kind == "duration":
            return parse_duration(token.text)
        if token.kind == "number" and token.text.isdigit():
            return int(token.text)
        raise QuerySyntaxError(f"expected a duration at {token.at}")

    def postfix(self, node):
        if self.accept("["):
            window = self.duration()
            if self.accept(":"):
                step = None if self.is_("]") else self.duration()
                node = Subquery(node, window, step)
            elif isinstance(node, Selector):
                node = Selector(node.name, node.matchers, window)
            else:
                raise QuerySyntaxError("a range needs a selector; a subquery has the form [range:step]")
            self.need("]")
        offset, at = 0, None
        if self.word("offset"):
            self.take()
            offset = self.duration()
        if self.accept("@"):
            if self.word("start", "end"):
                at = self.take().text.lower()
                self.need("(")
                self.need(")")
            else:
                sign = -1 if self.accept("-") else 1
                if self.now.kind != "number":
                    raise QuerySyntaxError(f"expected a time at {self.now.at}")
                at = sign * float(self.take().text)
        if not offset and at is None:
            return node
        if not isinstance(node, (Selector, Subquery)):
            raise QuerySyntaxError("offset and @ go with selectors and subqueries")
        return type(node)(**{f.name: getattr(node, f.name) for f in fields(node)} | {"offset": offset, "at": at})

    def primary(self):
        token = self.now
        if token.kind == "number":
            return Number(float(self.take().text))
        if token.kind == "text":
            return Text(_unquote(self.take().text))
        if self.accept("("):
            inner = self.expression()
            self.need(")")
            return inner
        if self.is_("{"):
            return self.selector(None)
        if token.kind == "word":
            following = self.tokens[self.k + 1]
            low = token.text.lower()
            if low in AGGREGATIONS and (following.text == "(" or following.text.lower() in ("by", "without")):
                return self.aggregate()
            if low in ("nan", "inf") and following.text not in ("{", "("):
                self.take()
                return Number(float(low))
            self.take()
            if self.is_("("):
                return self.call(token.text)
            return self.selector(token.text)
        raise QuerySyntaxError(f"unexpected {token.text or 'end of query'!r} at {token.at}")

    def selector(self, name: str | None) -> Selector:
        matchers = []
        if self.accept("{"):
            while not self.accept("}"):
                token = self.take()
                if token.kind == "text" and not self.is_("=", "==", "!=", "=~", "!~"):
                    name = self.once(name, _unquote(token.text))  # {"metric", ...}
                elif token.kind in ("word", "text"):
                    label = _unquote(token.text) if token.kind == "text" else token.text
                    if not self.is_("=", "==", "!=", "=~", "!~"):
                        raise QuerySyntaxError(f"expected a matcher at {self.now.at}")
                    op = self.take().text.replace("==", "=")
                    value = self.take()
                    if value.kind not in ("text", "word", "number", "duration"):
                        raise QuerySyntaxError(f"expected a value at {value.at}")
                    value = _unquote(value.text) if value.kind == "text" else value.text
                    if label == "__name__" and op == "=":
                        name = self.once(name, value)
                    else:
                        matchers.append(Matcher(label, op, value))
                else:
                    raise QuerySyntaxError(f"expected a label at {token.at}")
                if not self.accept(","):
                    self.need("}")
                    break
        for m in matchers:
            if m.op in ("=~", "!~"):
                try:
                    re.compile(m.value)
                except re.error as e:
                    raise QuerySyntaxError(f"bad pattern {m.value!r}: {e}") from None
        if name is None and not matchers:
            raise QuerySyntaxError("a selector needs a name or a matcher")
        return Selector(name, tuple(matchers))

    def once(self, name: str | None, new: str) -> str:
        if name is not None and name != new:
            raise QuerySyntaxError("a selector has one name")
        return new

    def grouping(self) -> tuple[tuple[str, ...], bool] | None:
        if self.word("by", "without"):
            without = self.take().text.lower() == "without"
            return self.names(), without
        return None

    def aggregate(self) -> Aggregate:
        op = self.take().text.lower()
        by = self.grouping()
        self.need("(")
        args = [self.expression()]
        while self.accept(","):
            args.append(self.expression())
        self.need(")")
        by = by or self.grouping() or ((), False)
        if len(args) != 1 + (op in PARAMETRIC):
            raise QuerySyntaxError(f"{op} takes {1 + (op in PARAMETRIC)} argument(s)")
        return Aggregate(op, args[-1], args[0] if op in PARAMETRIC else None, *by)

    def call(self, name: str) -> Call:
        self.need("(")
        args = []
        while not self.accept(")"):
            args.append(self.expression())
            if not self.accept(","):
                self.need(")")
                break
        return Call(name, tuple(args))


def parse(query: str):
    """The syntax tree of a query; raises QuerySyntaxError for anything else, an empty text included."""
    try:
        parser = _Parser(query)
        tree = parser.expression()
    except DurationError as e:
        raise QuerySyntaxError(str(e)) from None
    if parser.now.kind != "end":
        raise QuerySyntaxError(f"unexpected {parser.now.text!r} at {parser.now.at}")
    return tree
