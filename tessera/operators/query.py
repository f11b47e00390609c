"""A predicate language over nested documents, compiled to one Spark column.

Identity fields live in typed columns, so predicates on them reach the Parquet scan; all other paths are read from the
``body`` VARIANT. Logic is two-valued: a missing path or a value of another type makes a predicate false, and its
negation true.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Document paths that are columns of their own.
TYPED = {
    "base.id": "id",
    "base.session_id": "session_id",
    "base.name": "name",
    "base.datestamp": "datestamp",
    "document_class.class_name": "class_name",
}
COMPARISONS = {"lessthan": "__lt__", "lessthaneq": "__le__", "greaterthan": "__gt__", "greaterthaneq": "__ge__"}
OPERATIONS = {
    "exact_string", "exact_string_anycase", "contains_string", "regexp", "exact_number", *COMPARISONS,
    "hasfield", "hasmember", "isa", "depends_on", "or",
}
ALIASES = {"==": "exact_string", "notequal": "~exact_string", "hasanysubfield_contains_string": "contains_string"}
NO_CLASS = "no document has this class"


@dataclass(frozen=True)
class Term:
    """One predicate; ``operation`` may begin with ``~``."""

    path: str
    operation: str
    param1: object = None
    param2: object = None

    def negated(self) -> Term:
        other = self.operation[1:] if self.operation.startswith("~") else f"~{self.operation}"
        return Term(self.path, other, self.param1, self.param2)


@dataclass(frozen=True, eq=False)
class Query:
    """A conjunction of terms; unresolved while it only names a path."""

    path: str = ""
    terms: tuple[Term, ...] = field(default=())

    def _with(self, operation: str, param1=None, param2=None) -> Query:
        return Query(self.path, (Term(self.path, operation, param1, param2),))

    @classmethod
    def from_search(cls, path: str, operation: str, param1=None, param2=None) -> Query:
        """A query from an operation's name, with or without a leading ``~``."""
        operation = ALIASES.get(operation, operation)
        if operation == "exact_string" and isinstance(param1, (int, float)):
            operation = "exact_number"
        if operation.removeprefix("~") not in OPERATIONS:
            raise ValueError(f"unknown operation: {operation}")
        return cls(path, (Term(path, operation, param1, param2),))

    @classmethod
    def all(cls) -> Query:
        return cls().isa("base")

    @classmethod
    def none(cls) -> Query:
        return cls().isa(NO_CLASS)

    def __eq__(self, other):
        if isinstance(other, Query):
            return NotImplemented
        return self._with("exact_number" if isinstance(other, (int, float)) else "exact_string", other)

    def __ne__(self, other):
        if isinstance(other, Query):
            return NotImplemented
        return self._with("~exact_string", other)

    __hash__ = None

    def __lt__(self, other) -> Query:
        return self._with("lessthan", other)

    def __le__(self, other) -> Query:
        return self._with("lessthaneq", other)

    def __gt__(self, other) -> Query:
        return self._with("greaterthan", other)

    def __ge__(self, other) -> Query:
        return self._with("greaterthaneq", other)

    equals, less_than, less_than_or_equal, greater_than, greater_than_or_equal = __eq__, __lt__, __le__, __gt__, __ge__

    def equals(self, value) -> Query:
        return self == value

    def less_than(self, value) -> Query:
        return self < value

    def less_than_or_equal(self, value) -> Query:
        return self <= value

    def greater_than(self, value) -> Query:
        return self > value

    def greater_than_or_equal(self, value) -> Query:
        return self >= value

    def contains(self, value: str) -> Query:
        return self._with("contains_string", value)

    def match(self, pattern: str) -> Query:
        return self._with("regexp", pattern)

    def equals_any_case(self, value: str) -> Query:
        return self._with("exact_string_anycase", value)

    def has_field(self) -> Query:
        return self._with("hasfield")

    def has_member(self, value) -> Query:
        return self._with("hasmember", value)

    def isa(self, class_name: str) -> Query:
        return Query("", (Term("", "isa", class_name),))

    def depends_on(self, name: str, value: str) -> Query:
        """An edge with this name and value; ``*`` and an empty name stand for any."""
        return Query("", (Term("", "depends_on", name, value),))

    def __and__(self, other: Query) -> Query:
        return Query("", self.resolved() + other.resolved())

    def __or__(self, other: Query) -> Query:
        return Query("", (Term("", "or", self.resolved(), other.resolved()),))

    def __invert__(self) -> Query:
        """Every term negated by itself, so that ``~(a & b)`` is ``~a & ~b``; see :meth:`negate_all`."""
        return Query(self.path, tuple(t.negated() for t in self.resolved()))

    def negate_all(self) -> Query:
        """The documents that the whole query does not select."""
        return Query("", (Term("", "~or", self.resolved(), self.resolved()),))

    def resolved(self) -> tuple[Term, ...]:
        if not self.terms:
            raise ValueError(f"the query on {self.path!r} has no operation yet")
        return self.terms

    def __bool__(self) -> bool:
        self.resolved()
        return True

    def to_search(self) -> list[dict]:
        """The search structure: a list of terms as plain dictionaries."""

        def plain(t: Term) -> dict:
            side = lambda x: [plain(s) for s in x] if isinstance(x, tuple) else x
            return {"field": t.path, "operation": t.operation, "param1": side(t.param1), "param2": side(t.param2)}

        return [plain(t) for t in self.resolved()]

    @classmethod
    def of_search(cls, search: list[dict] | dict) -> Query:
        """The query of a search structure."""

        def term(d: dict) -> Term:
            side = lambda x: tuple(term(s) for s in x) if isinstance(x, list) else x
            name = ALIASES.get(d["operation"], d["operation"])
            if name.removeprefix("~") not in OPERATIONS:
                raise ValueError(f"unknown operation: {name}")
            return Term(d.get("field", ""), name, side(d.get("param1")), side(d.get("param2")))

        return cls("", tuple(term(d) for d in ([search] if isinstance(search, dict) else search)))

    def column(self, columns: Iterable[str] = ()) -> Column:
        """The predicate over a document table; ``columns`` are the table's, of which those of indexed paths are used."""
        known = frozenset(columns)
        return reduce(lambda a, b: a & b, [predicate(t, known) for t in self.resolved()])

    def paths(self) -> set[tuple[str, str]]:
        """The body paths that the query compares, and the kinds it compares them as."""

        def of(terms: tuple[Term, ...]) -> Iterator[tuple[str, str]]:
            for t in terms:
                name = t.operation.removeprefix("~")
                if name == "or":
                    yield from of(t.param1 + t.param2)
                elif t.path and t.path not in TYPED and name in KINDS:
                    yield t.path, KINDS[name]

        return set(of(self.resolved()))


#: The kind as which each operation compares a value.
KINDS = dict.fromkeys(("exact_string", "exact_string_anycase", "contains_string", "regexp"), "string") | dict.fromkeys(("exact_number", *COMPARISONS), "double")


def index_column(path: str, kind: str) -> str:
    """The name of the column that a store keeps for a body path."""
    return "body/" + path.replace(".", "/") + ":" + kind


def path_value(path: str, kind: str, columns: frozenset[str] = frozenset()) -> Column:
    """The value at a path as ``kind`` (a SQL type), or null; from the path's own column where ``columns`` has it."""
    if path in TYPED:
        return F.col(TYPED[path]) if kind == "string" else F.col(TYPED[path]).try_cast(kind)
    if index_column(path, kind) in columns:
        return F.col(f"`{index_column(path, kind)}`")
    quoted = "$" + "".join(f"['{p}']" if not p.isidentifier() else f".{p}" for p in path.split("."))
    return F.try_variant_get(F.col("body"), quoted, kind)


def predicate(t: Term, columns: frozenset[str] = frozenset()) -> Column:
    """One term as a column. Null stands for false, so that the engine can push a plain comparison to the scan."""
    name = t.operation.removeprefix("~")
    text = lambda: path_value(t.path, "string", columns)
    if name == "exact_string":
        out = text() == F.lit(str(t.param1))
    elif name == "exact_string_anycase":
        out = F.lower(text()) == F.lit(str(t.param1).lower())
    elif name == "contains_string":
        out = F.contains(text(), F.lit(str(t.param1)))
    elif name == "regexp":
        out = text().rlike(str(t.param1))
    elif name == "exact_number":
        out = path_value(t.path, "double", columns) == F.lit(float(t.param1))
    elif name in COMPARISONS:
        out = getattr(path_value(t.path, "double", columns), COMPARISONS[name])(F.lit(float(t.param1)))
    elif name == "hasfield":
        out = (F.col(TYPED[t.path]) if t.path in TYPED else path_value(t.path, "string")).isNotNull()
        if t.path not in TYPED:
            out = out | path_value(t.path, "array<variant>").isNotNull() | path_value(t.path, "map<string,variant>").isNotNull()
    elif name == "hasmember":
        out = F.array_contains(path_value(t.path, "array<string>"), F.lit(str(t.param1)))
    elif name == "isa":
        out = (F.col("class_name") == t.param1) | F.array_contains("superclasses", t.param1)
    elif name == "depends_on":
        any_name = t.param1 in ("", "*", None)
        out = F.exists("depends_on", lambda d: (d["value"] == t.param2) & (F.lit(True) if any_name else d["name"] == t.param1))
    elif name == "or":
        sides = [reduce(lambda a, b: a & b, [predicate(s, columns) for s in side]) for side in (t.param1, t.param2)]
        out = sides[0] | sides[1]
    else:
        raise ValueError(f"unknown operation: {t.operation}")
    return ~F.coalesce(out, F.lit(False)) if t.operation.startswith("~") else out


def search(documents: DataFrame, query: Query | None = None, session_id: str | None = None) -> DataFrame:
    """The documents that a query selects (all without one), of one session if given."""
    out = documents if session_id is None else documents.where(F.col("session_id") == session_id)
    found = out if query is None else out.where(query.column(documents.columns))
    return found.drop(*[c for c in documents.columns if c.startswith("body/")])
