"""Saved rules as lines of text: read, checked, written back, and applied to tables.

A rule is a clause (``label op value``) or a group: items joined by ``且`` (all hold), by ``或`` (some
holds), or ``都不(...)`` (none holds). A joiner has white space on both sides, one level has one kind of
joiner, and a parenthesis opens a group only where an item begins, so values may hold joiners
without white space and parentheses. Labels are a vocabulary's: each names a column and the kind of
its values. What is read is the rule tree of ``rules``, so saved texts compile to Columns and many
of them are evaluated in one pass over the facts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import All, AnyOf, Clause, NoneOf, clauses, compile_rule

AND, OR, NOT = "且", "或", "都不"
TEXT_OPS, NUMBER_OPS = ("=", "!=", "~", "^", "$"), ("=", "!=", "<=", "<", ">=", ">")


class Field(NamedTuple):
    column: str
    kind: str  # text, year, rating, size or number


# Labels of saved rules (fixed values) with this library's columns.
CATALOGUE = {
    "平台": Field("platform", "text"), "语言": Field("languages", "text"), "中文": Field("chinese", "text"), "合集": Field("collections", "text"), "收藏": Field("favorite", "text"),
    "类型": Field("genre", "text"), "作品": Field("work", "text"), "年份": Field("year", "year"), "评分": Field("rating", "rating"), "体积": Field("size", "size"),
    "开发商": Field("developer", "text"), "发行商": Field("publisher", "text"), "简介": Field("description", "text"),
}
# Bytes of a unit (fixed values); case is ignored.
UNITS = {"kib": 2**10, "mib": 2**20, "gib": 2**30, "tib": 2**40, "kb": 10**3, "mb": 10**6, "gb": 10**9, "tb": 10**12, "b": 1}


class RuleError(ValueError):
    """What is wrong with a rule text (``kind``), and where: ``at`` is a place in the text."""

    def __init__(self, kind: str, at: int, detail: str = ""):
        super().__init__(f"{kind} at {at}: {detail}")
        self.kind, self.at = kind, at


def number(kind: str, text: str) -> float | int | None:
    """A value as a number of its kind; None if it isn't one."""
    if kind == "year":
        return int(text) if re.fullmatch("[0-9]{4}", text) else None
    scale = 1.0
    if kind == "rating" and text.endswith("%"):
        text, scale = text[:-1].strip(), 0.01
    if kind == "size" and (unit := re.search("(?i)[kmgt]?i?b$", text)) and unit[0].lower() in UNITS:
        text, scale = text[: unit.start()].strip(), UNITS[unit[0].lower()]
    if not re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", text):
        return None
    value = float(text) / 100 if scale == 0.01 else float(text) * scale
    if not math.isfinite(value) or kind == "rating" and not 0 <= value <= 1 or kind == "size" and not 0 <= value < 2**64:
        return None
    return math.floor(value + 0.5) if kind == "size" else value


def clause(text: str, fields: dict[str, Field], at: int = 0) -> Clause:
    """``label op value``; the first operator parts them, of two at one place the longer."""
    op = re.search("!=|<=|>=|[=~^$<>]", text)
    if not op:
        raise RuleError("no operator", at, text)
    label, values = text[: op.start()].strip(), [v.strip() for v in text[op.end() :].split(",") if v.strip()]
    if label not in fields:
        raise RuleError("unknown label", at, label)
    column, kind = fields[label]
    if op[0] not in (TEXT_OPS if kind == "text" else NUMBER_OPS):
        raise RuleError("operator doesn't suit", at + op.start(), f"{label} {op[0]}")
    if not values:
        raise RuleError("no value", at + op.end(), label)
    if kind != "text":
        if len(values) > 1:
            raise RuleError("several values", at + op.end(), label)
        values = [number(kind, values[0])]
        if values[0] is None:
            raise RuleError("not a number", at + op.end(), text[op.end() :].strip())
    return Clause(column, op[0], *values, raw=f"{label}{op[0]}{text[op.end() :].strip()}")


def built(label: str, op: str, value: str, fields: dict[str, Field] = CATALOGUE) -> Clause:
    """A new clause, which must read back as itself wherever a group puts it: no joiner that white space parts, no odd parenthesis."""
    value = value.strip()
    if found := re.search(rf"(?<=\s)[{AND}{OR}](?=\s|$)", value):
        raise RuleError("joiner in a value", found.start(), value)
    depth = 0
    for k, c in enumerate(value):
        depth += (c == "(") - (c == ")")
        if depth < 0:
            raise RuleError("parentheses", k, value)
    if depth:
        raise RuleError("parentheses", len(value), value)
    if label not in fields:
        raise RuleError("unknown label", 0, label)
    return clause(f"{label}{op}{value}", fields)


def _tokens(text: str) -> Iterator[tuple[str, int, str]]:
    """(kind, place, text): ( ) 且 或 都不 and clauses."""
    joiner = re.compile(rf"(?<=\s)[{AND}{OR}](?=\s)")
    at, n = 0, len(text)
    owed = [0]  # for each open group, how many parentheses of its values are open
    while True:
        at += len(text[at:]) - len(text[at:].lstrip())
        if at == n:
            break
        if joiner.match(text, at):
            yield text[at], at, ""
            at += 1
        elif text.startswith(NOT, at):
            yield NOT, at, ""
            at += len(NOT)
        elif text[at] == "(":
            yield "(", at, ""
            at += 1
            owed.append(0)
        elif text[at] == ")" and len(owed) > 1 and not owed[-1]:
            yield ")", at, ""
            at += 1
            owed.pop()
        else:  # up to a joiner, or to the end of the group; parentheses of values are passed over
            begin = at
            while at < n and not joiner.match(text, at) and not (text[at] == ")" and len(owed) > 1 and not owed[-1]):
                owed[-1] += (text[at] == "(") - (text[at] == ")" and owed[-1] > 0)
                at += 1
            yield "clause", begin, text[begin:at].strip()


def parse(text: str, fields: dict[str, Field] = CATALOGUE):
    """The rule tree of a text; RuleError says what is wrong and where.

    Parentheses around one item mean nothing. ``都不(A 或 B)`` is none of A and B; around any other group it
    denies that group as a whole, so a double denial stays one.
    """
    tokens = [*_tokens(text), ("end", len(text), "")]
    k = 0

    def group(closing: str, opened: int):
        nonlocal k
        items, kind = [], None
        while tokens[k][0] != closing:
            word, at, found = tokens[k]
            if word == "end":
                raise RuleError("parentheses", opened, text)
            if word in (AND, OR):
                if kind not in (None, word):
                    raise RuleError("mixed joiners", at, text)
                kind = word
                k += 1
                continue
            if items and tokens[k - 1][0] not in (AND, OR):
                raise RuleError("no joiner", at, found or word)
            items.append(item())
        if not items:
            raise RuleError("empty", opened, text)
        return items[0] if len(items) == 1 else (AnyOf if kind == OR else All)(*items)

    def item():
        nonlocal k
        word, at, found = tokens[k]
        k += 1
        if word == "clause":
            return clause(found, fields, at)
        if word == NOT:
            if tokens[k][0] != "(":
                raise RuleError("nothing to deny", at, text)
            k += 1
        inner = group(")", at)
        k += 1
        if word != NOT:
            return inner
        return NoneOf(*inner) if isinstance(inner, AnyOf) else NoneOf(inner)

    return group("end", 0)


def render(rule, fields: dict[str, Field] = CATALOGUE, nested: bool = False) -> str:
    """A rule's canonical text; ``parse`` reads the same tree from it."""
    if isinstance(rule, Clause):
        if rule.raw:
            return rule.raw
        label = next(label for label, f in fields.items() if f.column == rule.column)
        return f"{label}{rule.op}{','.join(str(v) for v in rule.values)}"
    body = f" {AND if isinstance(rule, All) else OR} ".join(render(x, fields, True) for x in rule)
    if isinstance(rule, NoneOf):
        return f"{NOT}({body})"
    return f"({body})" if nested and len(rule) > 1 else body


def renamed(rule, column: str, old: str, new: str, fields: dict[str, Field] = CATALOGUE):
    """The rule with a text value of a column renamed; other columns' values and parts of longer values stay."""
    if isinstance(rule, Clause):
        if rule.column != column or old not in rule.values:
            return rule
        label = next(label for label, f in fields.items() if f.column == column)
        return built(label, rule.op, ",".join(new if v == old else v for v in rule.values), fields)
    return type(rule)(*(renamed(x, column, old, new, fields) for x in rule))


def any_of(rules: list):
    """One rule for several: what any of them takes; a single one stays as it is."""
    return rules[0] if len(rules) == 1 else AnyOf(*rules)


def same(a, b, fields: dict[str, Field] = CATALOGUE) -> bool:
    """Whether two rules are one tree, however they were written."""
    return parse(render(a, fields), fields) == parse(render(b, fields), fields)


def checked(rules: DataFrame, text: str = "rule", fields: dict[str, Field] = CATALOGUE) -> DataFrame:
    """The rules with (canonical, error, error_at, n_clauses): a text that can't be read is a row with its error; a null text is empty."""

    def one(value) -> tuple:
        try:
            found = parse(value or "", fields)
        except RuleError as e:
            return None, e.kind, e.at, None
        return render(found, fields), None, None, len(clauses(found))

    @F.pandas_udf("canonical string, error string, error_at int, n_clauses int")
    def told(values: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([one(v) for v in values], columns=["canonical", "error", "error_at", "n_clauses"], dtype=object)
        return out.astype({"error_at": "Int32", "n_clauses": "Int32"})

    return rules.withColumn("_told", told(F.col(text))).select(*rules.columns, "_told.*")


def hits(facts: DataFrame, key: str, rules: dict[str, str], fields: dict[str, Field] = CATALOGUE, multi: set[str] = frozenset(), columns: dict[str, Column] | None = None) -> DataFrame:
    """(key, rule): every fact and each saved rule (name: text) that takes it, in one pass over the facts.

    The rules are a user's list, so few; facts are read once and not shuffled.
    """
    columns = columns or {f.column: F.col(f.column) for f in fields.values() if f.column in facts.columns}
    flags = [F.when(compile_rule(parse(text, fields), columns, multi), F.lit(name)) for name, text in rules.items()]
    taken = F.filter(F.array(*flags), lambda x: x.isNotNull()) if flags else F.array().cast("array<string>")
    return facts.select(F.col(key), F.explode(taken).alias("rule"))


def gains(facts: DataFrame, chosen: list, candidates: dict[str, object], measure: str, columns: dict[str, Column] | None = None, multi: set[str] = frozenset()) -> DataFrame:
    """(rule, hits, added, added_total): what each candidate rule takes, and would add to what the chosen rules take.

    One pass with a few sums for each candidate; each candidate is weighed against the chosen ones
    alone. Null measures count as nothing.
    """
    columns = columns or {c: F.col(c) for c in facts.columns}
    had = compile_rule(AnyOf(*chosen), columns, multi)
    marked = facts.select(F.col(measure).alias("_m"), had.alias("_had"), *[compile_rule(r, columns, multi).alias(f"_{k}") for k, r in enumerate(candidates.values())])
    sums = []
    for k in range(len(candidates)):
        new = F.col(f"_{k}") & ~F.col("_had")
        sums += [F.count(F.when(F.col(f"_{k}"), 1)).alias(f"h{k}"), F.count(F.when(new, 1)).alias(f"n{k}"), F.coalesce(F.sum(F.when(new, F.col("_m"))), F.sum("_m") * 0).alias(f"t{k}")]
    if not sums:
        return facts.sparkSession.createDataFrame([], "rule string, hits long, added long, added_total double")
    one = marked.agg(*sums)
    return one.select(F.inline(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"h{k}").alias("hits"), F.col(f"n{k}").alias("added"), F.col(f"t{k}").alias("added_total")) for k, name in enumerate(candidates)])))
