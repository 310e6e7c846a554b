"""Ordered first-match rules, written as data and compiled to one CASE expression.

Tests compare text without regard to case: they expect lowered text, which ``first_match``
prepares once per column and row, not once per test. Each test turns a column name into
a SQL condition, so a whole rule list is parsed in one step.

A column that is only compared with whole values becomes the number of its value, and a test that several rules share is
made once. What the rules see is never NULL. This is for the size of the generated code: the JVM interprets methods of over
8,000 bytes for good.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

Test = Callable[[str], str]


def quoted(value: str) -> str:
    escaped = value.lower().replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


@dataclass(frozen=True)
class OneOf:
    """Equality with one of some values; it ignores trailing blanks."""

    values: tuple[str, ...]

    def __call__(self, c: str) -> str:
        return f"rtrim({c}) in ({', '.join(map(quoted, self.values))})"


def is_(*values: str) -> Test:
    return OneOf(values)


def is_not(value: str) -> Test:
    return lambda c: f"rtrim({c}) <> {quoted(value)}"


def begins(*prefixes: str) -> Test:
    return lambda c: "(" + " or ".join(f"startswith({c}, {quoted(p)})" for p in prefixes) + ")"


def has(*parts: str) -> Test:
    return lambda c: "(" + " or ".join(f"contains({c}, {quoted(p)})" for p in parts) + ")"


def lacks(part: str) -> Test:
    return lambda c: f"not {has(part)(c)}"


def begins_with_none(*prefixes: str) -> Test:
    return lambda c: f"{c} is not null and not {begins(*prefixes)(c)}"


@dataclass(frozen=True)
class Among:
    """Equality with one of some numbers."""

    values: tuple[int, ...]

    def __call__(self, c: str) -> str:
        return f"{c} in ({', '.join(map(str, self.values))})"


def number(*values: int) -> Test:
    return Among(values)


def holds() -> Test:
    return lambda c: c


def both(*tests: Test) -> Test:
    return lambda c: " and ".join(test(c) for test in tests)


@dataclass(frozen=True)
class Rule:
    """``then`` is the group id, or a column name whose value is used instead."""

    then: int | str
    tests: dict[str, Test] = field(default_factory=dict)

    def condition(self, terms: dict[tuple[str, Test], str]) -> str:
        return " and ".join(terms[item] for item in self.tests.items())


def rule(then: int | str, **tests: Test) -> Rule:
    return Rule(then, tests)


def named_values(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """What rules tell apart: text that they only compare with whole values is NULL where none of them names it.

    Rules hold for the same rows before and after. Summed by these columns, rows that no rule tells apart are one.
    """
    kinds = dict(df.dtypes)
    tests: dict[str, list[Test]] = {}
    for r in rules:
        for c, test in r.tests.items():
            tests.setdefault(c, []).append(test)
    plain = {c: found for c, found in tests.items() if kinds.get(c) == "string" and all(isinstance(test, OneOf) for test in found)}
    named = {c: ", ".join(sorted({quoted(v) for test in found for v in test.values})) for c, found in plain.items()}
    return df.selectExpr(*[f"case when rtrim(lower({c})) in ({named[c]}) then rtrim(lower({c})) end as {c}" if c in named else f"`{c}`" for c in df.columns])


def first_match(df: DataFrame, rules: Sequence[Rule], default: int | None, out: str = "group_id") -> DataFrame:
    """Add the result of the first rule whose tests all hold.

    A test on NULL counts as not holding, and ``default`` stands where no rule holds.
    """
    kinds = dict(df.dtypes)
    uses = Counter(item for r in rules for item in r.tests.items())
    prepared, shared, terms = [], [], {}
    for c in sorted({name for name, _ in uses}):
        tests = [test for name, test in uses if name == c]
        if kinds[c] == "string" and all(isinstance(test, OneOf) for test in tests):
            values = list(dict.fromkeys(quoted(v) for test in tests for v in test.values))
            numbers = ", ".join(f"{v}, {i}" for i, v in enumerate(values))
            prepared.append(f"coalesce(try_element_at(map({numbers}), rtrim(lower({c}))), -1) as _t_{c}")
            for test in tests:
                terms[c, test] = Among(tuple(values.index(quoted(v)) for v in test.values))(f"_t_{c}")
            continue
        if all(isinstance(test, Among) for test in tests):
            prepared.append(f"coalesce({c}, {min(v for test in tests for v in test.values) - 1}) as _t_{c}")
            terms.update({(c, test): test(f"_t_{c}") for test in tests})
            continue
        prepared.append(f"lower({c}) as _t_{c}" if kinds[c] == "string" else f"{c} as _t_{c}")
        for i, test in enumerate(tests):
            terms[c, test] = f"({test(f'_t_{c}')})"
            if kinds[c] == "string" and uses[c, test] > 1:
                shared.append(f"coalesce({terms[c, test]}, false) as _s_{c}_{i}")
                terms[c, test] = f"_s_{c}_{i}"
    arms = " ".join(f"when {r.condition(terms)} then {r.then}" for r in rules)
    case = f"cast(case {arms} else {'null' if default is None else default} end as int) as {out}"
    made = [column.rsplit(" as ", 1)[1] for column in [*prepared, *shared]]
    return df.selectExpr("*", *prepared).selectExpr("*", *shared).selectExpr("*", case).drop(*made)
