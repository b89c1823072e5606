"""Rule sets: named predicates evaluated in order on every row.

A rule is (condition as SQL, name).  Conditions stay inside whole-stage code
generation; NULL conditions do not hold.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = list[tuple[str, str]]


def all_broken(rules: Rules) -> Column:
    """Names of the rules that hold, in order, comma-joined."""
    return F.concat_ws(",", *[F.when(F.expr(p), F.lit(n)) for p, n in rules])


def first_broken(rules: Rules, otherwise: str) -> Column:
    return F.coalesce(*[F.when(F.expr(p), F.lit(n)) for p, n in rules], F.lit(otherwise))


def count_broken(rules: Rules) -> Column:
    return sum((F.coalesce(F.expr(p), F.lit(False)).cast("bigint") for p, _ in rules), F.lit(0).cast("bigint"))


def all_sql(rules: Rules) -> str:
    """The same in DuckDB's SQL."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {p} THEN '{n}' END" for p, n in rules) + ")"


def first_sql(rules: Rules, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {p} THEN '{n}'" for p, n in rules) + f" ELSE '{otherwise}' END"


def count_sql(rules: Rules) -> str:
    return " + ".join(f"CASE WHEN {p} THEN 1 ELSE 0 END" for p, _ in rules)
