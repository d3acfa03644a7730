"""Consistency rules as aggregated boolean columns, one row per (model, rule)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halocline.functions.special import all_finite
from halocline.functions.units import circular_velocity
from halocline.operators.models import MODEL

VALUES = ("adens", "apot", "fr")


def missing_artifacts(
    models: DataFrame, present: DataFrame, required: Sequence[str], *, keys: Sequence[str] = MODEL
) -> DataFrame:
    """Required names that a model lacks, from a table of the names it has, repeated at will."""
    wanted = models.select(*keys, F.explode(F.array(*[F.lit(n) for n in required])).alias("name"))
    # repeated names are combined where they are read
    return wanted.join(present.select(*keys, "name").distinct(), [*keys, "name"], "left_anti")


def finite_check(
    coefficients: DataFrame, *, values: Sequence[str] = VALUES, keys: Sequence[str] = MODEL
) -> DataFrame:
    """Count of non-finite values per coefficient column, and ``passed``."""
    out = coefficients.groupBy(*keys).agg(
        *[F.count_if(~all_finite(F.col(c))).alias(f"bad_{c}") for c in values], F.count(F.lit(1)).alias("n")
    )
    return out.withColumn("passed", sum((F.col(f"bad_{c}") for c in values), F.lit(0)) == 0)


def grid_match(left: DataFrame, right: DataFrame, *, keys: Sequence[str] = MODEL) -> DataFrame:
    """Whether (dr, nr, lmax) agree, per model; a model absent on one side does not match."""
    l = left.select(*keys, F.col("grid").alias("__l"))
    r = right.select(*keys, F.col("grid").alias("__r"))
    both = l.join(r, list(keys), "full")
    same = [F.col("__l")[f].eqNullSafe(F.col("__r")[f]) for f in ("dr", "nr", "lmax")]
    present = F.col("__l").isNotNull() & F.col("__r").isNotNull()
    return both.select(*keys, (present & same[0] & same[1] & same[2]).alias("matches"))


def close_check(
    left: DataFrame,
    right: DataFrame,
    *,
    on: Sequence[str],
    values: Sequence[str],
    keys: Sequence[str] = MODEL,
    rtol: float = 1e-5,
    atol: float = 1e-8,
) -> DataFrame:
    """Rows of two tables that differ by more than atol + rtol*|right|, or exist only once."""
    r = right.select(*on, *[F.col(v).alias(f"__{v}") for v in values])
    both = left.select(*on, *values).join(r, list(on), "full")
    ok = F.lit(True)
    for v in values:
        ok = ok & F.coalesce(F.abs(F.col(v) - F.col(f"__{v}")) <= F.abs(F.col(f"__{v}")) * rtol + atol, F.lit(False))
    return both.groupBy(*keys).agg(F.count_if(~ok).alias("different")).withColumn("passed", F.col("different") == 0)


def _rules(df: DataFrame, keys: Sequence[str], rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Unpivot {rule: (passed, observed)} over one-row-per-model input."""
    each = F.array(
        *[
            F.struct(
                F.lit(n).alias("rule"),
                F.coalesce(ok, F.lit(False)).alias("passed"),
                seen.cast("double").alias("observed"),
            )
            for n, (ok, seen) in rules.items()
        ]
    )
    out = df.select(*keys, F.explode(each).alias("__r")).select(*keys, "__r.rule", "__r.passed", "__r.observed")
    detail = F.when(F.col("passed"), F.lit("ok")).otherwise(
        F.concat(F.lit("failed: "), F.col("rule"))
    )
    return out.withColumn("detail", detail)


def consistency_report(
    catalog: DataFrame,
    *,
    keys: Sequence[str] = MODEL,
    manifest: DataFrame | None = None,
    stored: DataFrame | None = None,
    merged: DataFrame | None = None,
    reread: tuple[DataFrame, DataFrame] | None = None,
    force_at_8: DataFrame | None = None,
    masses: DataFrame | None = None,
    at_5: DataFrame | None = None,
    correction: DataFrame | None = None,
    scalars: DataFrame | None = None,
    missing: DataFrame | None = None,
) -> DataFrame:
    """Rows (rule, passed, observed, detail) per model, for the inputs that are given.

    ``catalog`` is the expected catalog, ``manifest`` and ``stored`` catalogs to match
    it, ``merged`` coefficients, ``reread`` two coefficient tables that must be
    close, ``force_at_8`` psi, f_r, f_z at R=8, ``masses`` (component, mass), ``at_5``
    omega and kappa at R=5, ``correction`` f_d at R=0, ``scalars`` (tidal_radius,
    toomre_q) and ``missing`` rows of :func:`missing_artifacts`.
    """
    k = list(keys)
    parts = []
    # an input without a row for a model is a failed rule of that model
    every = lambda df: catalog.select(*k).join(df, k, "left")
    if missing is not None:
        n = missing.groupBy(*k).agg(F.count(F.lit(1)).alias("n"))
        counted = catalog.select(*k).join(n, k, "left").withColumn("n", F.coalesce("n", F.lit(0)))
        parts.append(_rules(counted, k, {"artifacts_present": (F.col("n") == 0, F.col("n"))}))
    if manifest is not None:
        m = grid_match(catalog, manifest, keys=k)
        parts.append(_rules(m, k, {"grid_matches_manifest": (F.col("matches"), F.lit(None))}))
    if stored is not None:
        m = grid_match(catalog, stored, keys=k)
        parts.append(_rules(m, k, {"grid_matches_model": (F.col("matches"), F.lit(None))}))
        pair = catalog.select(*k, F.col("disk.mass").alias("a")).join(
            stored.select(*k, F.col("disk.mass").alias("b")), k, "left"
        )
        parts.append(_rules(pair, k, {"disk_mass_matches": (F.col("a").eqNullSafe(F.col("b")), F.col("b"))}))
    if reread is not None:
        c = close_check(*reread, on=[*k, "l", "ir"], values=["apot"], keys=k)
        parts.append(_rules(every(c), k, {"round_trip": (F.col("passed"), F.col("different"))}))
    if merged is not None:
        f = finite_check(merged, values=["apot"], keys=k)
        parts.append(_rules(every(f), k, {"merge_finite": (F.col("passed"), F.col("bad_apot"))}))
    if force_at_8 is not None:
        v = circular_velocity(F.col("f_r"), F.lit(8.0))
        parts.append(
            _rules(
                every(force_at_8),
                k,
                {
                    "potential_positive": (F.col("psi") > 0, F.col("psi")),
                    "force_inward": (F.col("f_r") < 0, F.col("f_r")),
                    "midplane_force_flat": (F.abs("f_z") <= 0.1, F.col("f_z")),
                    "circular_velocity_range": ((v > 1.0) & (v < 4.0), v),
                },
            )
        )
    if masses is not None:
        pick = lambda c: F.max(F.when(F.col("component") == c, F.col("mass")))
        m = masses.groupBy(*k).agg(pick("disk").alias("d"), pick("halo").alias("h"))
        parts.append(
            _rules(
                every(m),
                k,
                {
                    "masses_positive": ((F.col("d") > 0) & (F.col("h") > 0), F.least("d", "h")),
                    "halo_outweighs_disk": (F.col("h") >= F.col("d"), F.col("h") - F.col("d")),
                },
            )
        )
    if at_5 is not None:
        parts.append(
            _rules(
                every(at_5),
                k,
                {
                    "omega_positive": (F.col("omega") > 0, F.col("omega")),
                    "kappa_positive": (F.col("kappa") > 0, F.col("kappa")),
                },
            )
        )
    if correction is not None:
        parts.append(_rules(every(correction), k, {"central_correction": (F.col("f_d") >= 0.5, F.col("f_d"))}))
    if scalars is not None:
        q = F.col("toomre_q")
        parts.append(
            _rules(
                every(scalars),
                k,
                {
                    "tidal_radius_positive": (F.col("tidal_radius") > 0, F.col("tidal_radius")),
                    "toomre_range": ((q > 0.5) & (q < 3.0), q),
                },
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
