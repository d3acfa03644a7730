"""Bounded least squares for many groups at once, from normal equations that Spark sums.

Each pass over the data gives every open group its chi-squared, gradient and J^T J at a trial point; derivatives come with the
model (:mod:`halocline.functions.dual`).  Between passes each group takes a damped step by itself: a better trial is
taken and the damping falls, a worse one is forgotten and it rises.  What J^T J lacks of the second derivatives, which matters where the model
fits badly, is learned from the change of the gradient over the steps taken (a symmetric rank-one secant).  The work is passes, not grid points, a group costs
k(k+3)/2 + 1 sums for k parameters however many rows it has, and sums are combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halocline.functions.dual import Dual
from halocline.operators.keys import attach
from halocline.storage import discard, materialise, scratch_path

DAMPING, RISE, FALL = 1e-3, 8.0, 0.1
MOST_DAMPING = 1e14
# a group is done when a step moves no parameter by more than this share of its scale, or, after taking it, when it
# promises less than this share of chi-squared
STEP_TOLERANCE = 1e-11
GAIN_TOLERANCE = 1e-14

CONVERGED = "the step vanished"
FLAT = "no step lowers chi-squared any more"
UNFINISHED = "the passes ran out"
NO_ROWS = "no usable rows"


def _step(at: np.ndarray, half: np.ndarray, bend: np.ndarray, slope: np.ndarray, damping: float, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The damped step inside the bounds: parameters that a bound stops are left out, one after another.

    ``bend`` counts as long as the curvature with it is positive.
    """
    k = len(at)
    free = ~(((at <= lo) & (slope > 0)) | ((at >= hi) & (slope < 0)))
    move = np.zeros(k)
    while free.any():
        own = np.ix_(free, free)
        # a parameter that the data say nothing about stays where it is
        scale = np.diag(half[own]).copy()
        scale[scale <= 0] = 1.0
        move[:] = 0.0
        for a in (half[own] + bend[own], half[own]):
            try:
                np.linalg.cholesky(a + np.diag(damping * scale))
                move[free] = -np.linalg.solve(a + np.diag(damping * scale), slope[free])
                break
            except np.linalg.LinAlgError:
                continue
        else:
            return np.zeros(k)
        out = free & (((at + move < lo) & (at <= lo)) | ((at + move > hi) & (at >= hi)))
        if not out.any():
            break
        free &= ~out
    return np.clip(at + move, lo, hi) - at


def _advance(state: dict, chi2: float | None, slope: np.ndarray, half: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> dict:
    """A group's state after it has learned chi-squared and its derivatives at the trial point."""
    if chi2 is None or not np.isfinite(chi2) or not np.isfinite(half).all():
        if state["chi2"] is None:
            return state | {"done": True, "success": False, "message": NO_ROWS}
        chi2 = np.inf
    better = state["chi2"] is None or chi2 <= state["chi2"]
    if better:
        fall = FALL if state["chi2"] is not None else 1.0
        # J^T J alone is best while chi-squared falls fast; a secant over such a step would tell little
        slow = state["chi2"] is not None and chi2 > 0.5 * state["chi2"]
        bend = state["bend"] if slow else np.zeros_like(half)
        if slow:
            moved, turned = state["trial"] - state["at"], slope - state["slope"]
            rest = turned - (half + bend) @ moved
            if abs(rest @ moved) > 1e-8 * np.linalg.norm(rest) * np.linalg.norm(moved):
                bend = bend + np.outer(rest, rest) / (rest @ moved)
        state = state | {"bend": bend, "at": state["trial"], "chi2": chi2, "slope": slope, "half": half, "damping": max(state["damping"] * fall, 1e-12)}
    else:
        state = state | {"damping": state["damping"] * RISE}
    move = _step(state["at"], state["half"], state["bend"], state["slope"], state["damping"], lo, hi)
    gain = -(state["slope"] @ move) * 2.0
    scale = np.maximum(np.abs(state["at"]), 1e-3 * (hi - lo if np.isfinite(hi - lo).all() else 1.0))
    if (np.abs(move) <= STEP_TOLERANCE * scale).all():
        return state | {"done": True, "success": True, "message": CONVERGED if better else FLAT}
    if better and 0 <= gain <= GAIN_TOLERANCE * state["chi2"]:
        return state | {"at": state["at"] + move, "done": True, "success": True, "message": CONVERGED}
    if state["damping"] > MOST_DAMPING:
        return state | {"done": True, "success": True, "message": FLAT}
    return state | {"trial": state["at"] + move}


def least_squares_fit(
    df: DataFrame,
    model: Callable[[Mapping[str, Dual]], Dual],
    start: Mapping[str, float],
    *,
    observed: str,
    sigma: str | None = None,
    bounds: Mapping[str, tuple[float, float]] | None = None,
    group_cols: Sequence[str] = (),
    max_passes: int = 60,
) -> DataFrame:
    """The parameters of least chi-squared of ``model`` for each group, inside ``bounds``.

    Gives the groups, one column per parameter, ``chi2``, ``n`` (rows used), ``passes``, ``success`` and ``message``.  ``model`` takes
    the parameters as :class:`Dual` and may mix them with columns of ``df`` (``dual.col``).  Rows in which the model, the observed value or sigma is null or
    not finite, or sigma is zero, don't count; a group without others isn't a success.  A minimum at a bound is one.  Data are stored
    once; a pass reads those of open groups and keeps a row of state per group in a written table that replaces the last one.
    """
    g, names = list(group_cols), list(start)
    limits = {p: (bounds or {}).get(p, (-np.inf, np.inf)) for p in names}
    lo, hi = (np.array([float(limits[p][i]) for p in names]) for i in (0, 1))
    first = np.clip(np.array([float(start[p]) for p in names]), lo, hi)
    k = len(names)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    spark = df.sparkSession

    kept = scratch_path(spark, "fit-rows")
    rows = materialise(df, "fit-rows", kept)
    point = Dual.of(model({p: Dual(F.col(f"__p{i}"), {p: F.lit(1.0)}) for i, p in enumerate(names)}))
    weight = F.lit(1.0) if sigma is None else F.lit(1.0) / F.when(F.col(sigma) != 0, F.col(sigma))
    zero = F.lit(0.0)
    pull = (point.value - F.col(observed)) * weight
    slopes = [point.slopes.get(p, zero) * weight for p in names]

    doubles = "array<double>"
    schema = ", ".join(
        [*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*g).schema.fields], f"at {doubles}", "chi2 double", f"slope {doubles}", f"half {doubles}", f"bend {doubles}",
         "damping double", f"trial {doubles}", "done boolean", "success boolean", "message string", "n long", "passes int"]
    )

    def advance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for r in frame.to_dict("records"):
                known = r["chi2"] is not None and not pd.isna(r["chi2"])
                state = {
                    "at": np.array(r["at"]), "trial": np.array(r["trial"]), "damping": r["damping"], "done": False, "success": False, "message": UNFINISHED,
                    "chi2": float(r["chi2"]) if known else None, "slope": np.array(r["slope"]) if known else np.zeros(k),
                    "half": np.array(r["half"]).reshape(k, k) if known else np.eye(k), "bend": np.array(r["bend"]).reshape(k, k) if known else np.zeros((k, k)),
                }
                used = r["__n"] is not None and not pd.isna(r["__n"]) and r["__n"] > 0
                half = np.zeros((k, k))
                if used:
                    for (i, j), v in zip(pairs, r["__h"]):
                        half[i, j] = half[j, i] = v
                new = _advance(state, r["__chi2"] if used else None, np.array(r["__s"], float) if used else np.zeros(k), half, lo, hi)
                out.append({c: r[c] for c in g} | new | {"half": np.ravel(new["half"]), "bend": np.ravel(new["bend"]), "n": int(r["__n"]) if used else 0, "passes": int(r["passes"]) + 1})
            yield pd.DataFrame(out, columns=[*g, "at", "chi2", "slope", "half", "bend", "damping", "trial", "done", "success", "message", "n", "passes"])

    lit = lambda values: F.array(*[F.lit(float(v)) for v in values])
    groups = rows.select(*g).distinct() if g else spark.range(1).select()
    none = F.lit(None).cast(doubles)
    state = groups.select(
        *g, lit(first).alias("at"), F.lit(None).cast("double").alias("chi2"), none.alias("slope"), none.alias("half"), none.alias("bend"), F.lit(DAMPING).alias("damping"), lit(first).alias("trial"),
        F.lit(False).alias("done"), F.lit(False).alias("success"), F.lit(UNFINISHED).alias("message"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("passes"),
    )
    path = scratch_path(spark, "fit-state")
    state = materialise(state, "fit-state", path)
    for _ in range(max_passes):
        open_ = state.filter(~F.col("done"))
        placed = attach(rows, open_.select(*g, *[F.col("trial")[i].alias(f"__p{i}") for i in range(k)]), g)
        usable = placed.select(*g, pull.alias("__r"), *[s.alias(f"__d{i}") for i, s in enumerate(slopes)])
        finite = F.lit(True)
        for c in ("__r", *[f"__d{i}" for i in range(k)]):
            finite = finite & F.col(c).isNotNull() & (F.abs(c) < float("inf"))
        sums = usable.filter(finite).groupBy(*g).agg(
            F.count(F.lit(1)).alias("__n"),
            F.sum(F.col("__r") * F.col("__r")).alias("__chi2"),
            *[F.sum(F.col("__r") * F.col(f"__d{i}")).alias(f"__s{i}") for i in range(k)],
            *[F.sum(F.col(f"__d{i}") * F.col(f"__d{j}")).alias(f"__h{i}_{j}") for i, j in pairs],
        )
        sums = sums.select(*g, "__n", "__chi2", F.array(*[f"__s{i}" for i in range(k)]).alias("__s"), F.array(*[f"__h{i}_{j}" for i, j in pairs]).alias("__h"))
        moved = attach(open_, sums, g, "left").mapInPandas(advance, schema)
        newer = scratch_path(spark, "fit-state")
        state = materialise(moved.unionByName(state.filter("done")), "fit-state", newer)
        discard(spark, path)
        path = newer
        if state.filter(~F.col("done")).isEmpty():
            break
    discard(spark, kept)
    return state.select(*g, *[F.col("at")[i].alias(p) for i, p in enumerate(names)], "chi2", "n", "passes", "success", "message")
