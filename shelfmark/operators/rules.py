"""Rules over facts, as trees of groups and clauses that become one Column.

Rules are built from Python values (``rule_text`` reads saved ones from text): ``All(...)``, ``AnyOf(...)``, ``NoneOf(...)``
hold clauses and further groups. The law of missing values: where a row has no value, only
``!=`` holds. An array column holds several values; a clause holds if any of them satisfies it, and
``!=`` if none equals. Text compares with the case of A-Z ignored. All groups of nothing hold but
``AnyOf``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_lower

OPS = ("=", "!=", "~", "^", "$", "<=", "<", ">=", ">")


@dataclass(frozen=True)
class Clause:
    """``column op values``; any of several values will do (for ``!=``: none of them)."""

    column: str
    op: str
    values: tuple
    raw: str | None = field(default=None, compare=False)  # as it was written

    def __init__(self, column: str, op: str, *values, raw: str | None = None):
        if op not in OPS or not values or (op in ("<", "<=", ">", ">=") and len(values) > 1):
            raise ValueError(f"not a clause: {column} {op} {values}")
        for k, v in (("column", column), ("op", op), ("values", tuple(values)), ("raw", raw)):
            object.__setattr__(self, k, v)


class _Group(tuple):
    def __new__(cls, *items):
        return super().__new__(cls, items)

    def __eq__(self, other):
        return type(self) is type(other) and tuple.__eq__(self, other)

    __hash__ = tuple.__hash__


class All(_Group):
    """Every item holds."""


class AnyOf(_Group):
    """Some item holds."""


class NoneOf(_Group):
    """No item holds."""


def _test(value: Column, op: str, want) -> Column:
    if isinstance(want, str):
        value, want = ascii_lower(value), want.translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)}))
    want = F.lit(want)
    return {"=": lambda: value == want, "~": lambda: F.contains(value, want), "^": lambda: F.startswith(value, want), "$": lambda: F.endswith(value, want), "<=": lambda: value <= want, "<": lambda: value < want, ">=": lambda: value >= want, ">": lambda: value > want}[op]()


def compile_rule(rule, columns: dict[str, Column], multi: frozenset[str] | set[str] = frozenset()) -> Column:
    """A boolean Column, never null. ``columns`` maps names to values; names in ``multi`` are arrays."""
    if isinstance(rule, Clause):
        op = "=" if rule.op == "!=" else rule.op
        hit = lambda value: reduce(or_, [_test(value, op, v) for v in rule.values])
        found = F.exists(columns[rule.column], hit) if rule.column in multi else hit(columns[rule.column])
        found = F.coalesce(found, F.lit(False))
        return ~found if rule.op == "!=" else found
    parts = [compile_rule(x, columns, multi) for x in rule]
    if isinstance(rule, All):
        return reduce(and_, parts, F.lit(True))
    any_ = reduce(or_, parts, F.lit(False))
    return ~any_ if isinstance(rule, NoneOf) else any_


def filter_by(df: DataFrame, rule, columns: dict[str, Column] | None = None, multi: set[str] = frozenset()) -> DataFrame:
    """Rows that satisfy a rule.

    Clauses that must all hold become conjuncts of their own, bare of null handling (a filter takes
    a null as false), so those on numbers reach the scan as pushed filters. Text compares with case
    ignored, which no scan can do.
    """
    columns, todo = columns or {c: F.col(c) for c in df.columns}, [rule]
    while todo:
        x = todo.pop()
        if isinstance(x, All):
            todo += x
        elif isinstance(x, Clause) and x.op != "!=" and x.column not in multi:
            df = df.where(reduce(or_, [_test(columns[x.column], x.op, v) for v in x.values]))
        else:
            df = df.where(compile_rule(x, columns, multi))
    return df


def clauses(rule) -> list[Clause]:
    return [rule] if isinstance(rule, Clause) else [c for x in rule for c in clauses(x)]


def select_rows(facts: DataFrame, key: str, rules: list, exceptions: DataFrame, columns: dict[str, Column] | None = None, multi: set[str] = frozenset()) -> DataFrame:
    """Rows of any rule, then exceptions (key, included): they override the rules both ways.

    Exceptions join by key, so neither side needs to fit anywhere.
    """
    hit = compile_rule(AnyOf(*rules), columns or {c: F.col(c) for c in facts.columns}, multi)
    told = exceptions.groupBy(F.col("key").alias(key)).agg(F.max("included").alias("_included"))
    return facts.withColumn("_hit", hit).join(told, key, "left").where(F.coalesce("_included", "_hit")).drop("_hit", "_included")


def rule_hits(facts: DataFrame, rules: dict[str, object], measure: str, columns: dict[str, Column] | None = None, multi: set[str] = frozenset()) -> DataFrame:
    """(rule, hits, only_here, total): rows each rule takes, those no other takes, and their measure, in one pass."""
    columns = columns or {c: F.col(c) for c in facts.columns}
    flags = {name: compile_rule(r, columns, multi).cast("int") for name, r in rules.items()}
    n = reduce(lambda a, b: a + b, flags.values())
    marked = facts.select(F.col(measure).alias("_m"), n.alias("_n"), F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("hit")) for k, v in flags.items()]).alias("_rules"))
    each = marked.select("_m", "_n", F.inline("_rules"))
    return each.groupBy("rule").agg(F.sum("hit").alias("hits"), F.sum(F.when(F.col("_n") == 1, F.col("hit")).otherwise(0)).alias("only_here"), F.sum(F.when(F.col("hit") == 1, F.col("_m"))).alias("total"))


def thin_clauses(facts: DataFrame, rule, multi: set[str] = frozenset()) -> DataFrame:
    """(column, missing): how many rows have no value for each column that a rule asks about."""
    names = sorted({c.column for c in clauses(rule)})
    lack = lambda c: F.col(c).isNull() | (F.size(c) == 0) if c in multi else F.col(c).isNull()
    counted = facts.agg(*[F.count(F.when(lack(c), 1)).alias(c) for c in names])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in names])))
