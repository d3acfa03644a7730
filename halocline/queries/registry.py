"""Query registry.

A query states its output columns once; the same statement rounds the Spark
result and the SQL result, because sums of doubles differ in the last digits
between engines.  Values are scaled, moved off exact decimal ties (such as means over 32
rows, which could otherwise round either way) and rounded to an integer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halocline import fixtures as fx
from halocline.session import configure

Runner = Callable[[SparkSession, str], DataFrame]

_raw: dict[str, Runner] = {}
_queries: dict[str, Runner] = {}
_sql: dict[str, str] = {}

CTES = {
    "p": fx.PARTICLES_SQL,
    "pts": fx.POINTS_SQL,
    "models": fx.MODELS_SQL,
    "obs": fx.OBSERVED_SQL,
    "knots": fx.KNOTS_SQL,
    "coef": fx.coefficients_sql(1.0),
    "bary": fx.coefficients_sql(0.3),
}
NEEDS = {"pts": ("p",)}


def _columns(spec: str) -> list[tuple[str, str]]:
    """``"a n:i m:6"`` to pairs (name, kind): as is, bigint, or digits kept."""
    return [(n, k) for n, _, k in (token.partition(":") for token in spec.split())]


# Fraction of the last kept digit by which values are moved before rounding.
TIE_SHIFT = 0.037


def _spark_side(df: DataFrame, spec: str) -> DataFrame:
    out = []
    for name, kind in _columns(spec):
        c = F.col(name)
        if kind == "i":
            c = c.cast("bigint")
        elif kind:
            scale = 10.0 ** int(kind)
            c = F.rint(c.cast("double") * scale + TIE_SHIFT) / scale + 0.0
        out.append(c.alias(name))
    return df.select(*out)


def _sql_side(sql: str, spec: str, uses: str) -> str:
    cols = []
    for name, kind in _columns(spec):
        if kind == "i":
            cols.append(f"CAST({name} AS BIGINT) AS {name}")
        elif kind:
            cols.append(f"round(CAST({name} AS DOUBLE)*1e{kind} + {TIE_SHIFT}e0)/1e{kind} + 0e0 AS {name}")
        else:
            cols.append(name)
    names: list[str] = []
    for u in uses.split():
        names += [n for n in (*NEEDS.get(u, ()), u) if n not in names]
    ctes = [f"{n} AS MATERIALIZED ({CTES[n]})" for n in names]
    head = f"WITH {', '.join(ctes)} " if ctes else ""
    return f"{head}SELECT {', '.join(cols)} FROM ({sql}) result"


def query(name: str, columns: str, sql: str | None = None, uses: str = "p") -> Callable[[Runner], Runner]:
    """Register a runner under ``name``; ``uses`` lists the fixture tables its SQL reads."""

    def add(run: Runner) -> Runner:
        if name in _queries:
            raise ValueError(f"query {name} registered twice")
        _raw[name] = lambda spark, sf_dir: run(configure(spark), sf_dir)
        _queries[name] = lambda spark, sf_dir: _spark_side(run(configure(spark), sf_dir), columns)
        if sql is not None:
            _sql[name] = _sql_side(sql, columns, uses)
        return run

    return add


def raw_queries() -> dict[str, Runner]:
    """The operators alone, without the rounding of the parity check."""
    return dict(_raw)


def queries() -> dict[str, Runner]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
