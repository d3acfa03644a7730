"""Analytic densities, potentials and forces at points of many models.

Each field is a join of the points to the model catalog followed by a few
projections, with no shuffle of its own.  Points of a model that the catalog lacks
keep their row, with null results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halocline.functions import components as comp
from halocline.functions.special import sech2
from halocline.functions.stages import Stages, drop_temporaries, run, side_by_side
from halocline.operators.keys import lookup_join
from halocline.operators.models import MODEL
from halocline.operators.splines import spline_coefficients, spline_lookup


D1, D2, GAS, HALO = "__d1_", "__d2_", "__g_", "__h_"
R_SPH, PER_R = "__r", "__per_r"


def model_constants(catalog: DataFrame, parts: Sequence[str], keys: Sequence[str] = MODEL, *more: Column) -> DataFrame:
    """Keys, the flat constants of the given components, and ``more`` columns, one row per model."""
    make = {
        "disk": lambda c: comp.disk_constants(D1, c),
        "disk2": lambda c: comp.disk_constants(D2, c),
        "gas": lambda c: comp.gas_constants(GAS, c),
        "halo": lambda c: comp.halo_constants(HALO, c),
    }
    flat = [v.alias(n) for p in parts for n, v in make[p](F.col(p)).items()]
    return catalog.select(*keys, *more, *flat)


AT_R, AT_Z, KNOWN = "__at_R", "__at_z", "__known"


def with_constants(points: DataFrame, constants: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every point with its model's constants; ``__known`` is false, and they are zero, where the catalog lacks it.

    Filling them in keeps the formulas free of null checks; results are blanked by ``__known``.
    """
    named = constants.withColumn(KNOWN, F.lit(True))
    out = lookup_join(points, named, keys, "left")
    fill = {"boolean": F.lit(False), "int": F.lit(0), "bigint": F.lit(0), "double": F.lit(0.0)}
    return out.withColumns({c: F.coalesce(F.col(c), fill[kind]) for c, kind in named.dtypes if c not in keys})


def where_known(value: Column) -> Column:
    return F.when(F.col(KNOWN), value)


def point_coordinates(R: str, z: str | None) -> Stages:
    """The coordinates as doubles that are never null (a null counts as NaN).

    Nullable input would put a null check on every term of every formula below.
    """
    nan = F.lit(float("nan"))
    out = {AT_R: F.coalesce(F.col(R).cast("double"), nan)}
    if z is not None:
        out[AT_Z] = F.coalesce(F.col(z).cast("double"), nan)
    return [out]


def spherical_radius() -> Stages:
    """``__r`` and its reciprocal ``__per_r`` (zero at the origin) of the point coordinates."""
    R, z = F.col(AT_R), F.col(AT_Z)
    return [
        {R_SPH: F.sqrt(R * R + z * z)},
        {PER_R: F.coalesce(F.try_divide(F.lit(1.0), F.col(R_SPH)), F.lit(0.0))},
    ]


def _disk_and_gas(R: Column, z: Column, derivatives: int) -> Stages:
    r, per_r = F.col(R_SPH), F.col(PER_R)
    return side_by_side(
        *[comp.tapered_exponential(p, r, per_r, derivatives) for p in (D1, D2, GAS)],
        *[comp.disk_vertical(p, z) for p in (D1, D2)],
        comp.gas_height(GAS, R),
        comp.gas_layer(GAS, z),
    )


def analytic_stages(R: Column, z: Column) -> Stages:
    """Stages giving psi, f_r, f_z of each disk and the gas as ``__psi_<c>``, ``__fr_<c>``, ``__fz_<c>``.

    Needs the constants of all three and the spherical radius.
    """
    out = {}
    for name, p in (("disk", D1), ("disk2", D2)):
        fr, fz = comp.disk_force(p, R, z)
        out |= {f"__psi_{name}": comp.disk_potential(p), f"__fr_{name}": fr, f"__fz_{name}": fz}
    fr, fz = comp.gas_force(GAS, R, z)
    out |= {"__psi_gas": comp.gas_potential(GAS), "__fr_gas": fr, "__fz_gas": fz}
    return [*_disk_and_gas(R, z, 1), out]


def analytic_sum(kind: str) -> Column:
    """Sum of ``psi``, ``fr`` or ``fz`` over the parts."""
    return F.col(f"__{kind}_disk") + F.col(f"__{kind}_disk2") + F.col(f"__{kind}_gas")


def density_field(
    points: DataFrame, catalog: DataFrame, *, R: str = "R", z: str = "z", keys: Sequence[str] = MODEL
) -> DataFrame:
    """Densities per component, zero where switched off.

    ``rho_halo`` (NFW, null at the centre), ``rho_disk`` (exponential, sech^2), and the
    densities that match the analytic potentials: ``rho_disk_pot``,
    ``rho_disk2_pot``, ``rho_gas``.
    """
    s, h = F.col(AT_R), F.col(AT_Z)
    points = run(points, point_coordinates(R, z))
    out = with_constants(points, model_constants(catalog, ["halo", "disk", "disk2", "gas"], keys), keys)
    # the plain disk has a taper of its own, under another prefix
    plain = "__d0_"
    copies = {plain + n: F.col(D1 + n) for n in ("norm", "outer", "per_scale", "per_width", "per_height")}
    out = run(out, side_by_side(spherical_radius(), [copies]))
    out = run(out, side_by_side(_disk_and_gas(s, h, 2), comp.disk_surface(plain, s)))
    per_R = F.coalesce(F.try_divide(F.lit(1.0), s), F.lit(0.0))
    out = run(out, comp.gas_density(GAS, s, h, per_R))
    values = {
        "rho_halo": comp.nfw_density(HALO, F.col(R_SPH)),
        "rho_disk": F.col(plain + "sigma") * F.col(D1 + "per_height") * 0.5 * sech2(F.col(D1 + "zz")),
        "rho_disk_pot": comp.disk_matching_density(D1),
        "rho_disk2_pot": comp.disk_matching_density(D2),
        "rho_gas": F.col(GAS + "rho"),
    }
    out = out.withColumns({n: where_known(v) for n, v in values.items()})
    return drop_temporaries(out)


def surface_density_field(
    points: DataFrame, catalog: DataFrame, *, R: str = "R", keys: Sequence[str] = MODEL
) -> DataFrame:
    """Surface densities of the disks and the gas, and the gas scale height with derivatives."""
    s = F.col(AT_R)
    points = run(points, point_coordinates(R, None))
    out = with_constants(points, model_constants(catalog, ["disk", "disk2", "gas"], keys), keys)
    none = F.lit(0.0)
    stages = side_by_side(
        comp.disk_surface(D1, s),
        comp.tapered_exponential(D2, s, none, 0),
        comp.tapered_exponential(GAS, s, none, 0),
        comp.gas_height(GAS, s),
    )
    values = {
        "sigma_disk": F.col(D1 + "sigma"),
        # the radial factor of the potential is the surface density times half the height
        "sigma_disk2": F.col(D2 + "f") * F.col(D2 + "per_height") * 2.0,
        "sigma_gas": F.col(GAS + "f"),
        "gas_h": F.col(GAS + "h"),
        "gas_h1": F.col(GAS + "h1"),
        "gas_h2": F.col(GAS + "h2"),
    }
    out = run(out, stages).withColumns({n: where_known(v) for n, v in values.items()})
    return drop_temporaries(out)


def analytic_field(
    points: DataFrame, catalog: DataFrame, *, R: str = "R", z: str = "z", keys: Sequence[str] = MODEL
) -> DataFrame:
    """Struct columns ``field_disk``, ``field_disk2``, ``field_gas`` with psi, f_r and f_z."""
    placed = run(points, point_coordinates(R, z))
    out = with_constants(placed, model_constants(catalog, ["disk", "disk2", "gas"], keys), keys)
    out = run(out, [*spherical_radius(), *analytic_stages(F.col(AT_R), F.col(AT_Z))])

    def part(name: str) -> Column:
        names = {"psi": "psi", "f_r": "fr", "f_z": "fz"}
        return where_known(F.struct(*[F.col(f"__{n}_{name}").alias(f) for f, n in names.items()]))

    return out.select(*points.columns, *[part(n).alias(f"field_{n}") for n in ("disk", "disk2", "gas")])


def stability_table(
    frequencies: DataFrame,
    corrections: DataFrame,
    kinematics: DataFrame,
    *,
    surface_density: str = "sigma_d",
    keys: Sequence[str] = MODEL,
) -> DataFrame:
    """Epicycle frequency, radial dispersion and stability parameter per model and radius.

    ``frequencies`` (R, omega_h, d2psi_dr2 and the surface density), ``corrections``
    (R, f_d, on radii of their own: a natural spline gives f_d at the frequencies' radii) and
    ``kinematics`` (sigma_r0, sigma_r_scale per model).  One row per row of ``frequencies``; what
    needs a table that a model lacks is null.
    """
    k = list(keys)
    curve = spline_coefficients(corrections.select(*k, "R", "f_d"), x="R", y="f_d", group_cols=k)
    both = spline_lookup(frequencies, curve, at="R", x="R", y="f_d", out="f_d", group_cols=k)
    both = lookup_join(both, kinematics.select(*k, "sigma_r0", "sigma_r_scale"), k, "left")
    omega = F.col("omega_h")
    kappa = F.sqrt(F.greatest(F.lit(0.0), F.col("d2psi_dr2") + omega * omega * 3.0))
    out = both.withColumn("kappa", kappa).withColumn(
        "sigma_r_sq",
        F.col("sigma_r0") * F.col("sigma_r0") * F.exp(-F.col("R") / F.col("sigma_r_scale")) * F.col("f_d"),
    )
    critical = F.col(surface_density) * 3.36 / F.col("kappa")
    q = F.when(F.col("kappa") <= 0, F.lit(float("inf"))).otherwise(F.sqrt("sigma_r_sq") / critical)
    return out.withColumn("Q", q)
