"""A family of statistics: SQL over base relations, run on Spark and given as an oracle."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from breakwater.plans.dialect import render
from breakwater.sources import series, tables

#: Base relations: how Spark gets them from a data folder, and DuckDB's SQL.
BASES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}
#: Relations made of the segments of a view: the view, and what is made of them.
SEGMENTS: dict[str, tuple[series.View, Callable[[DataFrame], DataFrame]]] = {}
for _name, _view in series.VIEWS.items():
    BASES[f"seg_{_name}"] = (lambda s, d, v=_view: series.segments(s, d, v), series.segments_sql(_view))
    BASES[f"scoped_{_name}"] = (lambda s, d, v=_view: series.scoped(series.segments(s, d, v)), series.scoped_sql(_view))
    SEGMENTS |= {f"seg_{_name}": (_view, lambda segs: segs), f"scoped_{_name}": (_view, series.scoped)}
for _table in ("lineitem", "events", "supplier", "labels", "documents", "embeddings"):
    BASES[_table] = (lambda s, d, t=_table: s.read.parquet(f"{d}/{t}.parquet"), f"SELECT * FROM {_table}")


#: Segments that so many steps read are written first.
STAGED = 3


def way(run: Callable[[dict[str, DataFrame]], DataFrame], *reads: str) -> Callable[[dict[str, DataFrame]], DataFrame]:
    """Spark's way to a step from other relations than its text reads."""
    run.reads = reads
    return run


def _reads(step: tuple) -> tuple[str, ...] | None:
    """Relations that a step reads on Spark; None: not known."""
    name, text, *other = step
    declared = getattr(other[0], "reads", None) if other else None
    return declared if declared is not None else tuple(re.findall(r"\{(\w+)\}", text)) or None


@dataclass(frozen=True)
class Family:
    """``steps``: named SQL texts, each over base relations and earlier steps in braces; the last is the result.

    A step may have a third part, a function of the relations so far: Spark's way to the same
    rows, where SQL has only a plan that doesn't spread over executors.
    """

    name: str
    steps: tuple[tuple, ...]
    #: Relations of this family and what BASES gives for them.
    inputs: dict[str, str]

    def apply(self, spark: SparkSession, relations: dict[str, DataFrame]) -> DataFrame:
        """The result over DataFrames for the inputs."""
        have, needed = dict(relations), self._needed()
        for name, text, *other in self.steps:
            if name in needed:
                have[name] = other[0](have) if other else spark.sql(render(text, 0), **{k: v for k, v in have.items() if "{" + k + "}" in text})
        return have[self.steps[-1][0]]

    def query(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """The result over a data folder. Segments that several steps read are cut once and written, so their windows are not taken again for each."""
        made, given = {}, {}
        for k, base in self.inputs.items():
            if base in SEGMENTS and self._uses(k) >= STAGED:
                view, shape = SEGMENTS[base]
                if view not in made:
                    segs = series.segments(spark, sf_dir, view)
                    with tables.scans(spark, series.scans(segs)):
                        made[view] = tables.staged(segs, "segments")
                given[k] = shape(made[view])
            else:
                given[k] = BASES[base][0](spark, sf_dir)
        return self.apply(spark, given)

    def _needed(self) -> set[str]:
        """Steps that Spark's way to the result reads."""
        names = [s[0] for s in self.steps]
        found = {names[-1]}
        for step in reversed(self.steps):
            if step[0] in found:
                read = _reads(step)
                found |= set(names) if read is None else set(read)
        return found

    def _uses(self, relation: str) -> int:
        needed = self._needed()
        return sum(text.count("{" + relation + "}") if not hasattr((*other, None)[0], "reads") else other[0].reads.count(relation) for name, text, *other in self.steps if name in needed)

    def oracle(self) -> str:
        parts = [f"{k} AS ({BASES[base][1]})" for k, base in self.inputs.items()]
        for name, text, *_ in self.steps[:-1]:
            parts.append(f"{name} AS ({render(self._named(text), 1)})")
        recursive = "RECURSIVE " if any("{" + n + "}" in text for n, text, *_ in self.steps) else ""
        return f"WITH {recursive}{', '.join(parts)} {render(self._named(self.steps[-1][1]), 1)}"

    def _named(self, text: str) -> str:
        for k in [*self.inputs, *(s[0] for s in self.steps)]:
            text = text.replace("{" + k + "}", k)
        return text


def split(text: str) -> list[str]:
    """The parts of a select list."""
    depth, start, out = 0, 0, []
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()]


def outputs(text: str) -> list[str]:
    """Names of the columns of a query that selects them by name."""
    depth, end = 0, len(text)
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if not depth and text[i : i + 6] == " FROM ":
            end = i
            break
    return [part.split(" AS ")[-1].split(".")[-1] for part in split(text[len("SELECT ") : end])]


def kept(step: tuple) -> tuple:
    """A step that Spark writes to the shared folder, as later steps use it more than once."""
    name, text, *other = step

    def run(have: dict[str, DataFrame]) -> DataFrame:
        used = {k: v for k, v in have.items() if "{" + k + "}" in text}
        made = other[0](have) if other else next(iter(used.values())).sparkSession.sql(render(text, 0), **used)
        return tables.staged(made, name)

    if other and hasattr(other[0], "reads"):
        run.reads = other[0].reads
    return (name, text, run)


def dealt(df: DataFrame, key: str = "id") -> DataFrame:
    """``df`` over all shuffle partitions by a key: what follows costs time, not bytes, so small partitions must not be joined."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), key)


def spread(step: tuple, source: str, key: str = "id") -> tuple:
    """A step that Spark runs over ``source`` dealt out by ``key``; a grouping by the key then needs no other shuffle."""
    name, text = step
    return (name, text, lambda have: have[source].sparkSession.sql(render(text, 0), **{source: dealt(have[source], key)}))


def family(name: str, *steps: tuple | str, **inputs: str) -> Family:
    made = tuple(s if isinstance(s, tuple) else ("result", s) for s in steps)
    return Family(name, made, inputs or {"seg": "seg_suppliers"})


def columns(pairs: dict[str, str], keys: str = "id, scope") -> str:
    """Rounded output columns after the keys."""
    return keys + ", " + ", ".join(f"R({e}) AS {n}" for n, e in pairs.items())
