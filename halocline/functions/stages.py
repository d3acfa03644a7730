"""Long formulas as a few successive projections.

A formula with many shared terms, written as one expression, repeats those terms
until the generated method is too long for the JIT compiler.  Here it is a list
of stages: each stage is a dict of columns that may use names of earlier ones.
Terms used more than once are computed once, and each projection compiles to a
method of its own inside the same code-generation span.
"""

from __future__ import annotations

from itertools import zip_longest

from pyspark.sql import Column, DataFrame

Stage = dict[str, Column]
Stages = list[Stage]

PREFIX = "__"


def side_by_side(*parts: Stages) -> Stages:
    """Independent formulas advanced together, so that they share projections."""
    out: Stages = []
    for level in zip_longest(*parts, fillvalue={}):
        merged: Stage = {}
        for stage in level:
            merged |= stage
        out.append(merged)
    return out


def run(df: DataFrame, stages: Stages) -> DataFrame:
    for stage in stages:
        if stage:
            df = df.withColumns(stage)
    return df


def drop_temporaries(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(PREFIX)])
