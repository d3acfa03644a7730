"""Even-l multipole tables: merging, interpolation, potential and force.

Coefficients are long rows ``(model_id, l, ir, r, adens, apot, fr)`` on r = ir*dr.
One convention holds throughout: the potential is positive, the force is its
gradient, and ``fr`` is minus the radial derivative of ``apot``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halocline.functions.special import even_legendre, harmonic_norm
from halocline.functions.units import circular_velocity
from halocline.functions.stages import run
from halocline.operators.fields import (
    AT_R,
    AT_Z,
    PER_R,
    R_SPH,
    analytic_stages,
    analytic_sum,
    model_constants,
    point_coordinates,
    spherical_radius,
    with_constants,
    KNOWN,
)
from halocline.operators.keys import lookup_join, spread
from halocline.operators.models import COMPONENTS, MODEL, absent

VALUES = ("adens", "apot", "fr")


def _raise_unless(ok: Column, message: str, value: Column, type_name: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast(type_name))


def merge_harmonics(halo: DataFrame, baryon: DataFrame, *, keys: Sequence[str] = MODEL) -> DataFrame:
    """Sum two coefficient tables shell by shell; a shell or order missing in one is an error."""
    on = [*keys, "l", "ir"]
    h = halo.select(*on, F.col("r").alias("__rh"), *[F.col(c).alias(f"__h_{c}") for c in VALUES])
    b = baryon.select(*on, F.col("r").alias("__rb"), *[F.col(c).alias(f"__b_{c}") for c in VALUES])
    both = h.join(b, on, "full")
    same = F.coalesce(F.col("__rh") == F.col("__rb"), F.lit(False))
    return both.select(
        *on,
        _raise_unless(same, "coefficient grids differ", F.col("__rh"), "double").alias("r"),
        *[(F.col(f"__h_{c}") + F.col(f"__b_{c}")).alias(c) for c in VALUES],
    )


def merge_catalogs(halo: DataFrame, baryon: DataFrame, *, keys: Sequence[str] = MODEL) -> DataFrame:
    """Catalog of the merged models: baryon parameters with the halo's halo, flags combined.

    Grids must be equal.  Solver constants come from the halo side except the
    bulge normalisation.
    """
    k = list(keys)
    h = halo.select(*k, F.struct(*[c for c in halo.columns if c not in k]).alias("__h"))
    b = baryon.select(*k, F.struct(*[c for c in baryon.columns if c not in k]).alias("__b"))
    both = h.join(b, k, "full")
    # a model that only one catalog has is an error, as its missing shells are in merge_harmonics
    whole = lambda c, side: _raise_unless(F.col(c).isNotNull(), f"a model is missing from the {side} catalog", F.col(c), both.schema[c].dataType.simpleString())
    both = both.select(*k, whole("__h", "halo").alias("__h"), whole("__b", "baryon").alias("__b"))
    hs, bs = F.col("__h"), F.col("__b")

    def combined(c: str) -> Column:
        on = F.coalesce(bs[c]["enabled"], F.lit(False)) | F.coalesce(hs[c]["enabled"], F.lit(False))
        return F.coalesce(bs[c], hs[c]).withField("enabled", on)

    cols = {c: combined(c) if c in baryon.columns else absent(c) for c in COMPONENTS}
    cols["halo"] = hs["halo"].withField("enabled", F.lit(True))
    out = both.select(
        *k,
        *[v.alias(c) for c, v in cols.items()],
        _raise_unless(
            hs["grid"].eqNullSafe(bs["grid"]), "coefficient grids differ", bs["grid"], baryon.schema["grid"].dataType.simpleString()
        ).alias("grid"),
        *[hs[c].alias(c) for c in ("psi0", "halo_const", "psic", "psid") if c in halo.columns],
        *[bs[c].alias(c) for c in ("bulge_const", "kinematics") if c in baryon.columns],
    )
    return out


def harmonic_cells(coefficients: DataFrame, lmax: int, *, truncate: bool = False, keys: Sequence[str] = MODEL) -> DataFrame:
    """One row per (model, cell): coefficients on both shells of the cell, as flat columns.

    Each shell is sent to the cell it closes and the cell it opens, so that
    pairing and widening are the same aggregate.  Orders a model lacks are zero; orders above
    ``lmax`` are an error unless ``truncate`` leaves them out.
    """
    if lmax % 2:
        raise ValueError("lmax must be even")
    k = list(keys)
    sides = F.explode(
        F.array(
            F.struct(F.col("ir").alias("cell"), F.lit("hi").alias("side")),
            F.struct((F.col("ir") + 1).alias("cell"), F.lit("lo").alias("side")),
        )
    )
    if truncate:
        coefficients = coefficients.filter(F.col("l") <= lmax)
    l = _raise_unless(F.col("l") <= lmax, f"coefficients have orders above {lmax}; truncate=True leaves them out", F.col("l"), coefficients.schema["l"].dataType.simpleString())
    rows = coefficients.select(*k, l.alias("l"), *VALUES, sides.alias("__c"))
    rows = rows.select(*k, "l", *VALUES, "__c.cell", "__c.side")
    aggs = [F.bool_or(F.col("side") == s).alias(f"__{s}") for s in ("lo", "hi")]
    for l in range(0, lmax + 1, 2):
        for side in ("lo", "hi"):
            here = (F.col("l") == l) & (F.col("side") == side)
            aggs += [
                F.coalesce(F.max(F.when(here, F.col(v))), F.lit(0.0)).alias(f"{v}_{side}_{l}")
                for v in ("apot", "fr")
            ]
    return rows.groupBy(*k, "cell").agg(*aggs).filter(F.col("__lo") & F.col("__hi")).drop("__lo", "__hi")


def _locate(points: DataFrame, catalog: DataFrame, parts: Sequence[str], R: str, z: str, keys) -> DataFrame:
    """Points with the constants of their model and their radial cell."""
    g = F.col("grid")
    grid = [
        F.coalesce(F.lit(1.0) / g["dr"], F.lit(0.0)).alias("__per_dr"),
        F.coalesce(g["nr"] * g["dr"], F.lit(0.0)).alias("__edge"),
        F.coalesce(g["nr"], F.lit(0)).alias("__nr"),
        # a cell is found by division, as r/dr and r*(1/dr) may fall on either side of a shell
        F.coalesce(g["dr"], F.lit(1.0)).alias("__dr"),
    ]
    points = run(points, point_coordinates(R, z))
    out = run(with_constants(points, model_constants(catalog, parts, keys, *grid), keys), spherical_radius())
    # a model without a catalog row has no grid, and so no cell
    out = out.withColumn("__dr", F.when(F.col(KNOWN), F.col("__dr")).otherwise(1.0))
    cell = F.floor(F.col(R_SPH) / F.col("__dr")) + 1
    return out.withColumn("cell", F.least(F.greatest(cell, F.lit(1)), F.col("__nr")).cast("int"))


def _with_cells(located: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every located point with the coefficients of its cell, zero and not ``__known`` where there is none."""
    named = cells.withColumn("__cell", F.lit(True))
    out = lookup_join(located, named, [*keys, "cell"], "left", widened=True)
    values = [c for c in cells.columns if c not in (*keys, "cell")]
    known = F.col(KNOWN) & F.coalesce(F.col("__cell"), F.lit(False))
    return out.withColumns({KNOWN: known} | {c: F.coalesce(F.col(c), F.lit(0.0)) for c in values}).drop("__cell")


def _blend(name: str, l: int, t: Column) -> Column:
    return F.col(f"{name}_hi_{l}") * t + F.col(f"{name}_lo_{l}") * (F.lit(1.0) - t)


def _cell_columns(lmax: int) -> list[str]:
    return [
        f"{v}_{side}_{l}" for l in range(0, lmax + 1, 2) for v in ("apot", "fr") for side in ("lo", "hi")
    ]


def harmonic_interpolate(
    points: DataFrame,
    cells: DataFrame,
    catalog: DataFrame,
    *,
    lmax: int,
    R: str = "R",
    z: str = "z",
    keys: Sequence[str] = MODEL,
) -> DataFrame:
    """Coefficients ``apot_l`` and ``fr_l`` blended linearly in ``r_sph`` (the last cell extrapolates)."""
    out = _with_cells(_locate(points, catalog, [], R, z, keys), cells, keys)
    t = F.col(R_SPH) / F.col("__dr") - (F.col("cell") - 1)
    blended = {f"{v}_{l}": F.when(F.col(KNOWN), _blend(v, l, t)) for l in range(0, lmax + 1, 2) for v in ("apot", "fr")}
    return out.withColumns(blended).withColumnRenamed(R_SPH, "r_sph").drop(PER_R, AT_R, AT_Z, KNOWN, "__per_dr", "__edge", "__nr", "__dr", *_cell_columns(lmax))


def evaluate_force(
    points: DataFrame,
    cells: DataFrame,
    catalog: DataFrame,
    *,
    lmax: int,
    R: str = "R",
    z: str = "z",
    analytic: bool = True,
    keys: Sequence[str] = MODEL,
) -> DataFrame:
    """Potential and force (``psi``, ``f_r``, ``f_z``) at every point.

    Inside the table the coefficients are blended linearly; beyond its edge each
    order decays freely as r^-(l+1).  ``analytic`` adds the disk and gas parts of
    the model.  At the origin the force is zero.  A point of a model that the catalog
    or the cells lack keeps its row, with nulls.
    """
    parts = ["disk", "disk2", "gas"] if analytic else []
    out = _with_cells(_locate(points, catalog, parts, R, z, keys), cells, keys)
    s, h, r, per_r = (F.col(c) for c in (AT_R, AT_Z, R_SPH, PER_R))
    outside, cos, sin, t, q = (F.col(c) for c in ("__outside", "__cos", "__sin", "__t", "__q"))
    orders = range(0, lmax + 1, 2)
    place = {
        "__cos": h * per_r,
        "__sin": s * per_r,
        "__t": r * F.col("__per_dr") - (F.col("cell") - 1),
        "__q": F.col("__edge") * per_r,
        "__outside": r > F.col("__edge"),
    }
    # only the monopole is defined at the origin
    shrink, off_centre = F.lit(1.0), F.when(per_r == 0.0, 0.0).otherwise(1.0)
    radial, angular = {}, {}
    for l, (p, dp) in zip(orders, even_legendre(cos, lmax)):
        n = harmonic_norm(l)
        shrink = q if l == 0 else shrink * q * q
        decayed = F.col(f"apot_hi_{l}") * shrink
        inside = _blend("apot", l, t) if l == 0 else _blend("apot", l, t) * off_centre
        radial[f"__a{l}"] = F.when(outside, decayed).otherwise(inside)
        radial[f"__f{l}"] = F.when(outside, decayed * per_r * (l + 1.0)).otherwise(_blend("fr", l, t))
        angular |= {f"__p{l}": p * n, f"__d{l}": sin * dp * n}
    total = lambda a, b: sum((F.col(f"__{a}{l}") * F.col(f"__{b}{l}") for l in orders), F.lit(0.0))
    sums = {"__psi": total("p", "a"), "__frad": total("p", "f"), "__turn": total("d", "a")}
    out = run(out, [place, radial | angular, sums])
    psi = F.col("__psi")
    f_r = -(sin * F.col("__frad") + cos * per_r * F.col("__turn"))
    f_z = -(cos * F.col("__frad") - sin * per_r * F.col("__turn"))
    if analytic:
        out = run(out, analytic_stages(s, h))
        psi, f_r, f_z = psi + analytic_sum("psi"), f_r + analytic_sum("fr"), f_z + analytic_sum("fz")
        # on the axis point r = 0 no side is preferred
        f_r, f_z = f_r * off_centre, f_z * off_centre
    values = {"psi": psi, "f_r": f_r, "f_z": f_z}
    return out.select(*points.columns, *[F.when(F.col(KNOWN), v).alias(n) for n, v in values.items()])


def evaluate_potential(points: DataFrame, cells: DataFrame, catalog: DataFrame, **options) -> DataFrame:
    """Potential only; the unused force columns are pruned from the plan."""
    return evaluate_force(points, cells, catalog, **options).drop("f_r", "f_z")


def midplane_radii(catalog: DataFrame, *, n: int = 300, rmax: float = 100.0, keys: Sequence[str] = MODEL) -> DataFrame:
    """n equally spaced midplane points per model, up to ``rmax``."""
    step = rmax / n
    i = F.explode(F.sequence(F.lit(1), F.lit(n)))
    return spread(catalog.select(*keys), *keys).select(*keys, i.alias("i")).select(
        *keys, "i", (F.col("i") * step).alias("R"), F.lit(0.0).alias("z")
    )


def rotation_decomposition(
    total: DataFrame,
    halo: DataFrame,
    bulge: DataFrame | None = None,
    *,
    scale: float = 1.0,
    keys: Sequence[str] = MODEL,
) -> DataFrame:
    """Disk rotation left after halo and bulge, from three force tables on the same radii.

    Speeds are never imaginary: negative squares count as zero.  Models
    without a bulge table have a null ``v_bulge``.
    """
    on = [*keys, "i"]
    v = circular_velocity(F.col("f_r"), F.col("R"), scale)
    out = total.select(*on, F.col("R").alias("r"), v.alias("v_total"))
    out = out.join(halo.select(*on, v.alias("v_halo")), on)
    if bulge is None:
        out = out.withColumn("v_bulge", F.lit(None).cast("double"))
    else:
        out = out.join(bulge.select(*on, v.alias("v_bulge")), on, "left")
    square = lambda c: F.col(c) * F.col(c)
    left = square("v_total") - square("v_halo") - F.coalesce(square("v_bulge"), F.lit(0.0))
    return out.withColumn("v_disk", F.sqrt(F.greatest(F.lit(0.0), left)))


PART = "part"
PARTS = ("total", "halo", "bulge")


def tagged_cells(parts: Mapping[str, DataFrame]) -> DataFrame:
    """Cell tables of several parts of the same models as one, with the name of the part."""
    out = None
    for name, cells in parts.items():
        one = cells.withColumn(PART, F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def tagged_decomposition(
    radii: DataFrame,
    cells: DataFrame,
    catalog: DataFrame,
    *,
    lmax: int,
    analytic: bool = True,
    scale: float = 1.0,
    keys: Sequence[str] = MODEL,
) -> DataFrame:
    """Speeds of :func:`rotation_decomposition` from cells tagged by part, in one evaluation.

    ``cells`` has a column ``part``: total, halo and, for models that have one, bulge.  Every radius is looked up once for each part by (model,
    part, cell), and a radius' parts are then put side by side.  ``analytic`` adds the disk and gas of the catalog to the total.
    """
    k = list(keys)
    bare = [F.when(F.col(PART) == "total", F.col(c)).alias(c) if analytic else F.lit(None).cast(catalog.schema[c].dataType).alias(c) for c in ("disk", "disk2", "gas")]
    tagged = catalog.select(*k, "grid", F.explode(F.array(*[F.lit(p) for p in PARTS])).alias(PART), *[c for c in ("disk", "disk2", "gas")])
    tagged = tagged.select(*k, PART, "grid", *bare)
    points = radii.select(*k, "i", "R", "z", F.explode(F.array(*[F.lit(p) for p in PARTS])).alias(PART))
    forces = evaluate_force(points, cells, tagged, lmax=lmax, analytic=analytic, keys=[*k, PART])
    v = F.when(F.col("f_r").isNotNull(), circular_velocity(F.col("f_r"), F.col("R"), scale))
    out = forces.groupBy(*k, "i").agg(F.max("R").alias("r"), *[F.max(F.when(F.col(PART) == p, v)).alias(f"v_{p}") for p in PARTS])
    square = lambda c: F.col(c) * F.col(c)
    left = square("v_total") - square("v_halo") - F.coalesce(square("v_bulge"), F.lit(0.0))
    # as a join of the three would, a radius without a total or a halo gives no row
    out = out.filter(F.col("v_total").isNotNull() & F.col("v_halo").isNotNull())
    return out.withColumn("v_disk", F.sqrt(F.greatest(F.lit(0.0), left)))


def compare_to_observed(
    observed: DataFrame,
    cells: DataFrame,
    catalog: DataFrame,
    *,
    lmax: int,
    radius: str = "R_kpc",
    r_unit_kpc: float = 4.465,
    keys: Sequence[str] = MODEL,
) -> DataFrame:
    """Model circular velocity ``v_model`` at every observed radius."""
    at = observed.withColumn("__R", F.col(radius) / r_unit_kpc).withColumn("__z", F.lit(0.0))
    out = evaluate_force(at, cells, catalog, lmax=lmax, R="__R", z="__z", keys=keys)
    v = circular_velocity(F.col("f_r"), F.col("__R"))
    return out.withColumn("v_model", v).drop("__R", "__z", "psi", "f_r", "f_z")


def edge_correction(coefficients: DataFrame, catalog: DataFrame, *, keys: Sequence[str] = MODEL) -> DataFrame:
    """How far the last shell is from free decay: zero when apot = fr r/(l+1) for every l."""
    grid = catalog.select(*keys, F.col("grid")["nr"].alias("__nr"))
    last = lookup_join(coefficients, grid, keys).filter(F.col("ir") == F.col("__nr"))
    gap = F.col("apot") - F.col("fr") * F.col("r") / (F.col("l") + 1)
    return last.groupBy(*keys).agg((F.sum(gap) * harmonic_norm(0)).alias("edge_correction"))
