"""Closed nested declarations of JSON documents, compiled to one SQL expression: every broken rule is named with its path.

A declaration is made of ``Text``, ``Number``, ``Flag``, ``Listed`` and ``Record``. Compiled, it maps a variant to an array of
(path, problem), inside the engine: objects are read as maps, lists are walked by ``transform``, so one pass over a
document tells all that is wrong with it. Keys that a record does not declare are problems, unless it is open.

Expressions are written as text: a value is bound once and named, so that they grow with a declaration, not with its depth.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROBLEMS = "array<struct<path:string,problem:string>>"
NONE = f"cast(array() as {PROBLEMS})"
_names = itertools.count()


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, body) -> str:
    """``body`` of the name of a value that is computed once, however often it is named."""
    name = f"v{next(_names)}"
    return f"element_at(transform(array({value}), {name} -> {body(name)}), 1)"


def _problem(path: Path, text: str) -> str:
    return f"array(named_struct('path', {path}, 'problem', {_quoted(text)}))"


def _joined(parts: list[str]) -> str:
    return f"concat({', '.join(parts)})" if parts else NONE


def _rule(ok: str, path: Path, text: str) -> str:
    return f"if(coalesce({ok}, false), {NONE}, {_problem(path, text)})"


@dataclass(frozen=True)
class Path:
    """Where a value stands: text and, between brackets, the names of positions."""

    parts: tuple[str, ...] = ()

    def key(self, name: str) -> Path:
        """The path of a key, given as text."""
        return Path((*self.parts, _quoted(("." if self.parts else "") + name)))

    def named(self, name: str) -> Path:
        """The path of a key that ``name`` names in the expression."""
        return Path((*self.parts, *(["'.'"] if self.parts else []), name))

    def item(self, position: str) -> Path:
        return Path((*self.parts, "'['", position, "']'"))

    def __str__(self) -> str:
        return "''" if not self.parts else self.parts[0] if len(self.parts) == 1 else f"concat({', '.join(self.parts)})"


@dataclass(frozen=True)
class Node:
    """What all declarations share: whether JSON's null will do."""

    null: bool = field(default=False, kw_only=True)

    name = ""

    def kind(self, kind: str) -> str:
        """Whether a value's kind is right."""
        raise NotImplementedError

    def inner(self, v: str, path: Path) -> str:
        """Problems of a value of the right kind."""
        return NONE

    def problems(self, v: str, path: Path) -> str:
        other = _problem(path, f"is not {self.name}")
        missing, absent = _problem(path, "is missing"), NONE if self.null else other
        judged = lambda v, kind: f"case when {v} is null then {missing} when {kind} = 'VOID' then {absent} when {self.kind(kind)} then {self.inner(v, path)} else {other} end"
        return _let(v, lambda x: _let(f"schema_of_variant({x})", lambda kind: judged(x, kind)))


@dataclass(frozen=True)
class Text(Node):
    pattern: str | None = None
    among: tuple[str, ...] = ()
    filled: bool = False
    name = "text"

    def kind(self, kind: str) -> str:
        return f"{kind} = 'STRING'"

    def inner(self, v: str, path: Path) -> str:
        x, out = f"try_variant_get({v}, '$', 'string')", []
        if self.pattern:
            out.append(_rule(f"{x} rlike {_quoted(self.pattern)}", path, "has another form"))
        if self.among:
            out.append(_rule(f"{x} in ({', '.join(map(_quoted, self.among))})", path, "is none of " + ", ".join(self.among)))
        if self.filled:
            out.append(_rule(f"length({x}) > 0", path, "is empty"))
        return _joined(out)


@dataclass(frozen=True)
class Number(Node):
    low: float | None = None
    high: float | None = None
    above: float | None = None
    equal: float | None = None
    name = "a number"

    def kind(self, kind: str) -> str:
        return f"{kind} rlike '^(BIGINT|DECIMAL|DOUBLE)'"

    def inner(self, v: str, path: Path) -> str:
        x, out = f"try_variant_get({v}, '$', 'double')", []
        if self.equal is not None:
            out.append(_rule(f"{x} = {self.equal}", path, f"is not {self.equal:g}"))
        for sign, bound in ((">=", self.low), ("<=", self.high), (">", self.above)):
            if bound is not None:
                out.append(_rule(f"{x} {sign} {bound}", path, "is out of range"))
        return _joined(out)


@dataclass(frozen=True)
class Flag(Node):
    name = "true or false"

    def kind(self, kind: str) -> str:
        return f"{kind} = 'BOOLEAN'"


@dataclass(frozen=True)
class Listed(Node):
    """A list of like items; ``unique`` is the key of theirs, or "" for the items themselves, that may not repeat."""

    item: Node | None = None
    count: int | None = None
    unique: str | None = None
    name = "a list"

    def kind(self, kind: str) -> str:
        return f"startswith({kind}, 'ARRAY')"

    def inner(self, v: str, path: Path) -> str:
        return _let(f"variant_get({v}, '$', 'array<variant>')", lambda items: self._of(items, path))

    def _of(self, items: str, path: Path) -> str:
        out, n = [], next(_names)
        at = path.item(f"k{n}")
        if self.count is not None:
            out.append(_rule(f"size({items}) = {self.count}", path, f"has not {self.count} items"))
        if self.item:
            out.append(f"flatten(transform({items}, (x{n}, k{n}) -> {self.item.problems(f'x{n}', at)}))")
        if self.unique is not None:
            key = f"to_json(try_variant_get(x{n}, {_quoted('$.' + self.unique)}, 'variant'))" if self.unique else f"to_json(x{n})"
            again = lambda keys: f"transform({keys}, (x{n}, k{n}) -> if(array_position({keys}, x{n}) <= k{n}, named_struct('path', {at}, 'problem', {_quoted('repeats ' + (self.unique or 'an item'))}), null))"
            out.append(f"array_compact({_let(f'transform({items}, x{n} -> {key})', again)})")
        return _joined(out)


@dataclass(frozen=True)
class Record(Node):
    """An object of declared keys. ``optional`` ones may be missing; ``open_`` ones may have others beside. ``also`` are further
    rules (key below, problem, SQL in which {0} is the record) for records whose keys are as declared."""

    keys: dict[str, Node] = field(default_factory=dict)
    optional: frozenset[str] = frozenset()
    open_: bool = False
    also: tuple[tuple[str, str, str], ...] = ()
    name = "an object"

    def kind(self, kind: str) -> str:
        return f"startswith({kind}, 'OBJECT')"

    def inner(self, v: str, path: Path) -> str:
        found = _let(f"variant_get({v}, '$', 'map<string,variant>')", lambda held: self._of(held, path))
        if not self.also:
            return found
        rules = _joined([_rule(ok.format(v), path.key(at), text) for at, text, ok in self.also])
        return _let(found, lambda x: f"if(size({x}) = 0, {rules}, {x})")

    def _of(self, held: str, path: Path) -> str:
        out, n = [], next(_names)
        for name, node in self.keys.items():
            value = f"try_element_at({held}, {_quoted(name)})"
            found = node.problems(value, path.key(name))
            out.append(f"if({value} is null, {NONE}, {found})" if name in self.optional else found)
        if not self.open_:
            known = f"array({', '.join(map(_quoted, self.keys))})" if self.keys else "cast(array() as array<string>)"
            out.append(f"transform(array_sort(array_except(map_keys({held}), {known})), k{n} -> named_struct('path', {path.named(f'k{n}')}, 'problem', 'is unknown'))")
        return _joined(out)


def problems_of(declaration: Node) -> Column:
    """Problems of the column ``content``, JSON text: an array of (path, problem)."""
    found = _let("try_parse_json(content)", lambda v: f"case when content is null then {_problem(Path(), 'is missing')} when {v} is null then {_problem(Path(), 'is not JSON')} else {declaration.problems(v, Path())} end")
    return F.expr(found)


def document_problems(documents: DataFrame, declaration: Node, key: str = "name") -> DataFrame:
    """(key, path, problem) of documents (key, content as JSON text): a row for each broken rule; text that is no JSON is one.

    A null content is missing. An empty table has no problems.
    """
    return documents.select(F.col(key), F.explode(problems_of(declaration)).alias("p")).select(key, "p.path", "p.problem")


def checked_documents(documents: DataFrame, declaration: Node, key: str = "name") -> DataFrame:
    """The documents; the first that breaks a rule fails with all its problems."""
    said = F.array_join(F.transform("_found", lambda p: F.concat_ws(" ", p["path"], p["problem"])), "; ")
    ok = F.when(F.size("_found") > 0, F.raise_error(F.concat(F.col(key).cast("string"), F.lit(": "), said)).cast("boolean")).otherwise(F.lit(True))
    return documents.withColumn("_found", problems_of(declaration)).where(ok).drop("_found")


def items_of(documents: DataFrame, field_name: str, schema: str) -> DataFrame:
    """A row for each item of a list in checked documents (content), by a fixed schema; whatever it nests is kept."""
    items = F.from_json(F.get_json_object("content", f"$.{field_name}"), f"array<struct<{schema}>>", {"mode": "FAILFAST"})
    return documents.select(F.explode(items).alias("x")).select("x.*")
