"""A small template language, compiled to Python closures.

    text                                          stands for itself
    {{ expression }}                              the value as text; none is empty
    {% if a %} .. {% elif b %} .. {% else %} .. {% endif %}
    {% for m in messages %} .. {% endfor %}       once in a template, over the messages as they come
    {% generation %} .. {% endgeneration %}       marks what a model is to generate
    {# comment #}                                 nothing

Expressions have the fields of the loop's message, loop.index, loop.index0, loop.first and loop.last,
constants (strings, whole numbers, true, false, none), comparison, `in`, and, or, not, `+` of strings,
`x if c else y`, and the filters of FILTERS and those given, as in `m.text | trim`. There are no calls, no
other names or attributes and no assignment, so a template reads its messages only and what it writes is
proportional to them.

Compiling has three steps: parsing into a syntax tree, folding of whatever is constant (expressions,
filters, branches, neighbouring text), and closures, one for each node left.

A message field that is missing is none. A template without a loop renders its text once.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

Env = dict[str, object]
Value = Callable[[Env], object]
#: What rendering yields besides text: a generation begins, and ends.
BEGIN, END = 1, 2
Part = str | int
Render = Callable[[Env], Iterator[Part]]

FILTERS: dict[str, Callable[[str], object]] = {
    "trim": str.strip,
    "upper": str.upper,
    "lower": str.lower,
    "length": len,
}
_LOOP = ("index", "index0", "first", "last")
_CONSTANTS = {"true": True, "false": False, "none": None}
_TAG = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.DOTALL)
_FOR = re.compile(r"for\s+([A-Za-z_]\w*)\s+in\s+messages\Z")


class TemplateError(ValueError):
    """The template says something it can't or mustn't."""


# ---- syntax tree


@dataclass
class Text:
    text: str


@dataclass
class Output:
    value: Const | Field | Call


@dataclass
class If:
    branches: list[tuple[object, list]]
    other: list


@dataclass
class For:
    name: str
    body: list


@dataclass
class Generation:
    body: list


@dataclass
class Const:
    value: object


@dataclass
class Field:
    """A field of the message, or of the loop."""

    owner: str
    name: str


@dataclass
class Call:
    """An operation on values: its name, how to compute it, and what on."""

    name: str
    function: Callable[..., object]
    of: list


@dataclass
class Choice:
    """The first value that decides: `and`, `or` and `x if c else y` don't compute the rest."""

    kind: str
    of: list


# ---- parsing


class _Parser:
    def __init__(self, source: str, filters: dict[str, Callable[[str], object]]) -> None:
        self.parts = [part for part in _TAG.split(source) if part]
        self.at = 0
        self.filters = filters
        self.names: list[str] = []
        self.looped = False

    def parse(self) -> list:
        body, ended = self._body(())
        assert not ended
        return body

    def _body(self, ends: tuple[str, ...]) -> tuple[list, str]:
        """Nodes up to a tag that begins with one of `ends`, and that tag."""
        nodes: list = []
        while self.at < len(self.parts):
            part = self.parts[self.at]
            self.at += 1
            if part.startswith("{{") and part.endswith("}}"):
                nodes.append(Output(self._expression(part[2:-2])))
            elif part.startswith("{#") and part.endswith("#}"):
                continue
            elif part.startswith("{%") and part.endswith("%}"):
                tag = part[2:-2].strip()
                word = tag.split(None, 1)[0] if tag else ""
                if word in ends:
                    return nodes, tag
                nodes.append(self._statement(tag, word))
            else:
                nodes.append(Text(part))
        if ends:
            raise TemplateError(f"{' or '.join(ends)} is missing")
        return nodes, ""

    def _statement(self, tag: str, word: str) -> If | For | Generation:
        if word == "if":
            branches, ended = [], tag
            while ended.split(None, 1)[0] != "endif":
                if ended == "else":
                    other, _ = self._body(("endif",))
                    return If(branches, other)
                condition = self._expression(ended.split(None, 1)[1] if " " in ended else "")
                body, ended = self._body(("elif", "else", "endif"))
                branches.append((condition, body))
            return If(branches, [])
        if word == "for":
            named = _FOR.match(tag)
            if not named or self.looped:
                raise TemplateError("a template has one loop, over messages")
            self.looped = True
            self.names = [named[1]]
            body, _ = self._body(("endfor",))
            self.names = []
            return For(named[1], body)
        if tag == "generation":
            body, _ = self._body(("endgeneration",))
            if any(isinstance(node, Generation) for node in _walk(body)):
                raise TemplateError("a generation lies within another")
            return Generation(body)
        raise TemplateError(f"unknown tag: {tag!r}")

    def _expression(self, text: str) -> object:
        try:
            tree = ast.parse(text.strip(), mode="eval").body
        except (SyntaxError, ValueError) as error:
            raise TemplateError(f"no expression: {text!r}") from error
        return self._value(tree)

    def _value(self, node: ast.expr) -> object:
        match node:
            case ast.Constant(value=str() | bool() | int() | None):
                return Const(node.value)
            case ast.Name(id=name) if name in _CONSTANTS:
                return Const(_CONSTANTS[name])
            case ast.Attribute(value=ast.Name(id=owner), attr=name) if self._known(owner, name):
                return Field(owner, name)
            case ast.Subscript(value=ast.Name(id=owner), slice=ast.Constant(value=str(name))):
                if self._known(owner, name):
                    return Field(owner, name)
            case ast.BinOp(left=left, op=ast.BitOr(), right=ast.Name(id=name)) if name in self.filters:
                function = self.filters[name]
                return Call(name, lambda x: function("" if x is None else _string(x)), [self._value(left)])
            case ast.BinOp(left=left, op=ast.Add(), right=right):
                return Call("+", lambda x, y: _string(x) + _string(y), [self._value(left), self._value(right)])
            case ast.UnaryOp(op=ast.Not(), operand=operand):
                return Call("not", lambda x: not x, [self._value(operand)])
            case ast.BoolOp(op=op, values=values):
                return Choice("and" if isinstance(op, ast.And) else "or", [self._value(v) for v in values])
            case ast.IfExp(test=test, body=yes, orelse=no):
                return Choice("if", [self._value(v) for v in (test, yes, no)])
            case ast.Compare(left=left, ops=[op], comparators=[right]) if type(op) in _COMPARE:
                return Call(type(op).__name__, _COMPARE[type(op)], [self._value(left), self._value(right)])
        raise TemplateError(f"not allowed in a template: {ast.unparse(node)}")

    def _known(self, owner: str, name: str) -> bool:
        if name.startswith("_") or not self.names:
            return False
        return name in _LOOP if owner == "loop" else owner in self.names


def _string(x: object) -> str:
    if not isinstance(x, str):
        raise TemplateError(f"no text: {x!r}")
    return x


_COMPARE: dict[type, Callable[[object, object], object]] = {
    ast.Eq: lambda x, y: x == y,
    ast.NotEq: lambda x, y: x != y,
    ast.Lt: lambda x, y: x < y,
    ast.LtE: lambda x, y: x <= y,
    ast.Gt: lambda x, y: x > y,
    ast.GtE: lambda x, y: x >= y,
    ast.In: lambda x, y: _string(x) in _string(y),
    ast.NotIn: lambda x, y: _string(x) not in _string(y),
}


def _walk(nodes: list) -> Iterator[object]:
    for node in nodes:
        yield node
        match node:
            case If(branches, other):
                for _, body in branches:
                    yield from _walk(body)
                yield from _walk(other)
            case For(_, body) | Generation(body):
                yield from _walk(body)


# ---- folding


def _fold_value(node: object) -> object:
    match node:
        case Call(name, function, of):
            of = [_fold_value(x) for x in of]
            if all(isinstance(x, Const) for x in of):
                try:
                    return Const(function(*[x.value for x in of]))
                except TypeError as error:
                    raise TemplateError(f"{name} doesn't go with its values") from error
            return Call(name, function, of)
        case Choice("if", [test, yes, no]):
            test = _fold_value(test)
            if isinstance(test, Const):
                return _fold_value(yes if test.value else no)
            return Choice("if", [test, _fold_value(yes), _fold_value(no)])
        case Choice(kind, of):
            left: list = []
            for x in map(_fold_value, of):
                decides = isinstance(x, Const) and bool(x.value) == (kind == "or")
                left.append(x)
                if decides:
                    break
            # A constant before the last that doesn't decide has no say.
            left = [x for x in left[:-1] if not isinstance(x, Const)] + left[-1:]
            return left[0] if len(left) == 1 else Choice(kind, left)
    return node


def _shown(value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        raise TemplateError("a truth value has no text")
    return str(value)


def fold(nodes: list) -> list:
    """The same tree with everything constant computed."""
    out: list = []
    for node in nodes:
        match node:
            case Output(value):
                value = _fold_value(value)
                new = [Text(_shown(value.value)) if isinstance(value, Const) else Output(value)]
            case If(branches, other):
                new = _fold_if(branches, other)
            case For(name, body):
                new = [For(name, fold(body))]
            case Generation(body):
                new = [Generation(fold(body))]
            case _:
                new = [node]
        for one in new:
            if isinstance(one, Text) and out and isinstance(out[-1], Text):
                out[-1] = Text(out[-1].text + one.text)
            elif one != Text(""):
                out.append(one)
    return out


def _fold_if(branches: list[tuple[object, list]], other: list) -> list:
    left = []
    for condition, body in branches:
        condition = _fold_value(condition)
        if not isinstance(condition, Const):
            left.append((condition, fold(body)))
        elif condition.value:
            other = body
            break
    other = fold(other)
    return [If(left, other)] if left else other


# ---- closures


def _closure(node: object) -> Value:
    match node:
        case Const(value):
            return lambda env: value
        case Field(owner, name):
            return lambda env: env[owner].get(name)
        case Call(_, function, [one]):
            of = _closure(one)
            return lambda env: function(of(env))
        case Call(_, function, [one, two]):
            left, right = _closure(one), _closure(two)
            return lambda env: function(left(env), right(env))
        case Choice("if", of):
            test, yes, no = map(_closure, of)
            return lambda env: yes(env) if test(env) else no(env)
        case Choice(kind, of):
            values, wanted = [_closure(x) for x in of], kind == "or"

            def first(env: Env) -> object:
                for value in values:
                    found = value(env)
                    if bool(found) == wanted:
                        break
                return found

            return first
    raise AssertionError(node)


def _renderer(nodes: list) -> Render:
    steps = [_step(node) for node in nodes]
    if len(steps) == 1:
        return steps[0]

    def run(env: Env) -> Iterator[Part]:
        for step in steps:
            yield from step(env)

    return run


def _step(node: object) -> Render:
    match node:
        case Text(text):
            return lambda env: iter((text,))
        case Output(value):
            shown = _closure(value)
            return lambda env: iter((_shown(shown(env)),))
        case If(branches, other):
            tests = [(_closure(condition), _renderer(body)) for condition, body in branches]
            otherwise = _renderer(other)

            def choose(env: Env) -> Iterator[Part]:
                for test, body in tests:
                    if test(env):
                        return body(env)
                return otherwise(env)

            return choose
        case Generation(body):
            inner = _renderer(body)

            def marked(env: Env) -> Iterator[Part]:
                yield BEGIN
                yield from inner(env)
                yield END

            return marked
        case For(name, body):
            each = _renderer(body)

            def loop(env: Env) -> Iterator[Part]:
                ahead = iter(env["messages"])
                message = next(ahead, None)
                index = 0
                while message is not None:
                    following = next(ahead, None)
                    place = {"index": index + 1, "index0": index, "first": not index, "last": following is None}
                    yield from each({name: message, "loop": place})
                    message, index = following, index + 1

            return loop
    raise AssertionError(node)


class Template:
    """A compiled template. `filters` are added to FILTERS."""

    def __init__(self, source: str, filters: dict[str, Callable[[str], object]] | None = None) -> None:
        self.tree = fold(_Parser(source, FILTERS | (filters or {})).parse())
        self._run = _renderer(self.tree)

    def render(self, messages: Iterable[dict[str, object]]) -> Iterator[Part]:
        """Text, BEGIN and END, as the messages come; no more than one message ahead is taken."""
        return self._run({"messages": messages})

    def literals(self) -> list[str]:
        """All constant text of the template."""
        return [node.text for node in _walk(self.tree) if isinstance(node, Text)]
