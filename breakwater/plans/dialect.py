"""One text of a plan for two engines.

Families are written as SQL over named relations, with a few macros where the engines'
names or semantics differ. Spark runs them through ``spark.sql`` over DataFrames, so
Catalyst plans them like any other DataFrame; DuckDB runs them as the oracle.
"""

from __future__ import annotations

import re

MACROS = {
    # name: (Spark, DuckDB)
    "PCT": ("percentile({0}, {1})", "quantile_cont({0}, {1})"),
    "DIV": ("try_divide(CAST({0} AS DOUBLE), CAST({1} AS DOUBLE))", "(CAST({0} AS DOUBLE) / nullif(CAST({1} AS DOUBLE), 0))"),
    # Rounded to 4 decimals, never -0; shifted a little, as the engines differ on decimal ties.
    "R": ("CASE WHEN round({0} + 1e-9, 4) = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(round({0} + 1e-9, 4) AS DOUBLE) END",) * 2,
    # The same to 8 decimals, for values that are small.
    "R8": ("CASE WHEN round({0} + 1e-13, 8) = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(round({0} + 1e-13, 8) AS DOUBLE) END",) * 2,
    "MINBY": ("min_by({0}, {1})", "arg_min({0}, {1})"),
    "MAXBY": ("max_by({0}, {1})", "arg_max({0}, {1})"),
    "BIG": ("CAST({0} AS BIGINT)",) * 2,
    "DBL": ("CAST({0} AS DOUBLE)",) * 2,
    "LN": ("ln({0})",) * 2,
    "PRE": ("{0} FILTER (WHERE period = 0)",) * 2,
    "POST": ("{0} FILTER (WHERE period = 1)",) * 2,
    "V0": ("max(CASE WHEN period = 0 THEN {0} END)",) * 2,
    "V1": ("max(CASE WHEN period = 1 THEN {0} END)",) * 2,
    "PCTF": ("percentile(value, {0}) FILTER (WHERE period = {1})", "quantile_cont(value, {0}) FILTER (WHERE period = {1})"),
    # Folds the expression {3} of acc and k over the whole numbers from {0} to {1}, from {2} on.
    "FOLD": ("aggregate(transform(sequence({0}, {1}), i -> CAST(i AS DOUBLE)), CAST({2} AS DOUBLE), (acc, k) -> CAST({3} AS DOUBLE))", "list_reduce(list_prepend(CAST({2} AS DOUBLE), list_transform(range({0}, {1} + 1), lambda i_ : CAST(i_ AS DOUBLE))), lambda acc, k : CAST({3} AS DOUBLE))"),
    # The values {0} in the order of {1}, of the rows where {2}.
    "SERIES": ("transform(array_sort(collect_list(struct({1} AS o, CAST({0} AS DOUBLE) AS v)) FILTER (WHERE {2})), s -> s.v)", "coalesce(list(CAST({0} AS DOUBLE) ORDER BY {1}) FILTER (WHERE {2}), [])"),
    # A local-level filter over the array {0} with process variance {1} and noise {2}: level, p, and sums s1 and s2 of its errors and their squares.
    "FILTER": (
        "aggregate(slice({0}, 2, greatest(size({0}) - 1, 0)), named_struct('level', get({0}, 0), 'p', CAST({2} AS DOUBLE), 's1', CAST(0 AS DOUBLE), 's2', CAST(0 AS DOUBLE)), "
        "(st_, nx_) -> named_struct('level', st_.level + (nx_ - st_.level) * ((st_.p + {1}) / (st_.p + {1} + {2})), 'p', (st_.p + {1}) * {2} / (st_.p + {1} + {2}), 's1', st_.s1 + (nx_ - st_.level), 's2', st_.s2 + (nx_ - st_.level) * (nx_ - st_.level)))",
        "CASE WHEN len({0}) > 0 THEN list_reduce(list_transform({0}, lambda one_ : {{'level': one_, 'p': CAST({2} AS DOUBLE), 's1': CAST(0 AS DOUBLE), 's2': CAST(0 AS DOUBLE)}}), "
        "lambda st_, nx_ : {{'level': st_.level + (nx_.level - st_.level) * ((st_.p + {1}) / (st_.p + {1} + {2})), 'p': (st_.p + {1}) * {2} / (st_.p + {1} + {2}), 's1': st_.s1 + (nx_.level - st_.level), 's2': st_.s2 + (nx_.level - st_.level) * (nx_.level - st_.level)}}) END",
    ),
    # The array of an expression {2} of k over the whole numbers from {0} to {1}; none if {1} is below {0}.
    "OVER": ("CASE WHEN {1} < {0} THEN CAST(array() AS ARRAY<DOUBLE>) ELSE transform(sequence(CAST({0} AS INT), CAST({1} AS INT)), k -> CAST({2} AS DOUBLE)) END", "list_transform(range(CAST({0} AS BIGINT), CAST({1} AS BIGINT) + 1), lambda k : CAST({2} AS DOUBLE))"),
    "ITEM": ("get({0}, CAST({1} AS INT))", "({0})[CAST({1} AS INT) + 1]"),
    "LEN": ("size({0})", "len({0})"),
    "MD5": ("md5(CAST({0} AS STRING))", "md5(CAST({0} AS VARCHAR))"),
}
_NAME = re.compile(r"\b(" + "|".join(MACROS) + r")\(")


def arguments(text: str, at: int) -> tuple[list[str], int]:
    """Arguments of the call whose parenthesis opens before ``at``, and where it ends."""
    depth, start, out = 1, at, []
    for i in range(at, len(text)):
        c = text[i]
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
            if not depth:
                return [*out, text[start:i].strip()], i + 1
        elif c == "," and depth == 1:
            out.append(text[start:i].strip())
            start = i + 1
    raise ValueError(f"no closing parenthesis: {text[at : at + 60]}")


def render(text: str, engine: int) -> str:
    """The text for an engine: 0 is Spark, 1 is DuckDB."""
    while m := _NAME.search(text):
        args, end = arguments(text, m.end())
        text = text[: m.start()] + "(" + MACROS[m[1]][engine].format(*args) + ")" + text[end:]
    return text
