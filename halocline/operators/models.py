"""Model catalog: one row per galaxy model, one nullable struct per component."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halocline.functions import components as comp
from halocline.functions.units import DEFAULT_UNITS, UnitSystem

MODEL = ("model_id",)

HALO = "struct<r_outer:double,v0:double,a:double,dr_trunc:double,cusp:double,enabled:boolean>"
DISK = (
    "struct<mass:double,scale_length:double,outer_radius:double,scale_height:double,"
    "trunc_width:double,hole_radius:double,core_radius:double,enabled:boolean>"
)
DISK2 = (
    "struct<mass:double,scale_length:double,outer_radius:double,scale_height:double,"
    "trunc_width:double,enabled:boolean>"
)
GAS = (
    "struct<mass:double,scale_length:double,outer_radius:double,z_scale:double,trunc_width:double,"
    "rz_scale:double,z_max:double,gamma:double,enabled:boolean>"
)
BULGE = "struct<n_sersic:double,ppp:double,v0:double,a:double,enabled:boolean>"
BLACK_HOLE = "struct<mass:double,enabled:boolean>"
GRID = "struct<dr:double,nr:int,lmax:int>"
KINEMATICS = "struct<sigma_r0:double,sigma_r_scale:double,n_radial_steps:int,n_iterations:int>"

COMPONENTS = {
    "halo": HALO,
    "disk": DISK,
    "disk2": DISK2,
    "gas": GAS,
    "bulge": BULGE,
    "black_hole": BLACK_HOLE,
}
SETTINGS = {"grid": GRID, "kinematics": KINEMATICS}
BARYONS = ("disk", "disk2", "gas", "bulge", "black_hole")


def component(kind: str, **fields: Column | float | bool) -> Column:
    """Struct column of one component or setting, cast to its schema."""
    cols = [(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()]
    return F.struct(*cols).cast((COMPONENTS | SETTINGS)[kind])


def absent(kind: str) -> Column:
    return F.lit(None).cast((COMPONENTS | SETTINGS)[kind])


# Default parameters in physical units (kpc, km/s, solar masses).
PHYSICAL_DEFAULTS: dict[str, float | bool] = {
    "halo_enabled": True,
    "halo_r_outer_kpc": 200.0,
    "halo_v0_kms": 370.0,
    "halo_a_kpc": 33.0,
    "halo_dr_trunc_kpc": 12.0,
    "halo_cusp": 1.0,
    "disk_enabled": True,
    "disk_mass_msun": 3.9525e10,
    "disk_scale_length_kpc": 2.5,
    "disk_outer_radius_kpc": 20.25,
    "disk_scale_height_kpc": 0.25,
    "disk_trunc_width_kpc": 3.0,
    "sigma_r0_kms": 85.0,
    "sigma_r_scale_kpc": 2.8,
    "grid_dr_kpc": 0.1,
    "grid_nr": 800,
    "grid_lmax": 2,
}


def model_from_physical(
    df: DataFrame, *, units: UnitSystem = DEFAULT_UNITS, keys: Sequence[str] = MODEL
) -> DataFrame:
    """Catalog rows in internal units from physical-unit columns.

    Columns are named as in :data:`PHYSICAL_DEFAULTS`; missing columns and nulls
    take the default.
    """

    def given(name: str) -> Column:
        default = F.lit(PHYSICAL_DEFAULTS[name])
        return F.coalesce(F.col(name), default) if name in df.columns else default

    def length(name: str) -> Column:
        return units.from_physical(given(name), "length")

    def velocity(name: str) -> Column:
        return units.from_physical(given(name), "velocity")

    return df.select(
        *keys,
        component(
            "halo",
            r_outer=length("halo_r_outer_kpc"),
            v0=velocity("halo_v0_kms"),
            a=length("halo_a_kpc"),
            dr_trunc=length("halo_dr_trunc_kpc"),
            cusp=given("halo_cusp"),
            enabled=given("halo_enabled"),
        ).alias("halo"),
        component(
            "disk",
            mass=units.from_physical(given("disk_mass_msun"), "mass"),
            scale_length=length("disk_scale_length_kpc"),
            outer_radius=length("disk_outer_radius_kpc"),
            scale_height=length("disk_scale_height_kpc"),
            trunc_width=length("disk_trunc_width_kpc"),
            hole_radius=0.0,
            core_radius=1.5,
            enabled=given("disk_enabled"),
        ).alias("disk"),
        *[absent(c).alias(c) for c in ("disk2", "gas", "bulge")],
        component("black_hole", mass=0.0, enabled=False).alias("black_hole"),
        component(
            "grid", dr=length("grid_dr_kpc"), nr=given("grid_nr"), lmax=given("grid_lmax")
        ).alias("grid"),
        component(
            "kinematics",
            sigma_r0=velocity("sigma_r0_kms"),
            sigma_r_scale=length("sigma_r_scale_kpc"),
            n_radial_steps=50,
            n_iterations=10,
        ).alias("kinematics"),
    )


# Parameters of the named models, in internal units.
_WIDE_DISK = {
    "mass": 17.0,
    "scale_length": 2.5,
    "outer_radius": 20.25,
    "scale_height": 0.25,
    "trunc_width": 3.0,
    "hole_radius": 0.0,
    "core_radius": 1.5,
}
_WARM = {"sigma_r0": 0.85, "sigma_r_scale": 2.8, "n_radial_steps": 50, "n_iterations": 10}
PRESETS: dict[str, dict[str, dict[str, float]]] = {
    "milky_way": {
        "halo": {"r_outer": 200.0, "v0": 3.7, "a": 33.0, "dr_trunc": 12.0, "cusp": 1.0},
        "disk": _WIDE_DISK,
        "grid": {"dr": 0.02, "nr": 20000, "lmax": 6},
        "kinematics": _WARM,
    },
    "milky_way_coarse": {
        "halo": {"r_outer": 80.0, "v0": 3.7, "a": 33.0, "dr_trunc": 12.0, "cusp": 1.0},
        "disk": _WIDE_DISK,
        "grid": {"dr": 0.1, "nr": 800, "lmax": 2},
        "kinematics": _WARM,
    },
    "nfw_halo": {
        "halo": {"r_outer": 100.0, "v0": 2.0, "a": 10.0, "dr_trunc": 8.0, "cusp": 1.0},
        "grid": {"dr": 0.05, "nr": 2000, "lmax": 0},
    },
    "sersic_bulge": {
        "bulge": {"n_sersic": 4.0, "ppp": 0.5, "v0": 2.5, "a": 0.5},
        "grid": {"dr": 0.02, "nr": 5000, "lmax": 4},
    },
    "nfw_bulge": {
        "halo": {"r_outer": 100.0, "v0": 2.5, "a": 15.0, "dr_trunc": 10.0, "cusp": 1.0},
        "bulge": {"n_sersic": 4.0, "ppp": 0.5, "v0": 1.5, "a": 0.4},
        "grid": {"dr": 0.02, "nr": 8000, "lmax": 4},
    },
}


def with_preset(df: DataFrame, preset: Column | str) -> DataFrame:
    """``df`` with the catalog columns of the named model that ``preset`` gives each row; an unknown name is an error."""
    name = F.col(preset) if isinstance(preset, str) else preset
    known = F.when(name.isin(list(PRESETS)), name).otherwise(F.raise_error(F.concat(F.lit("no such model: "), name)))

    def column(kind: str) -> Column:
        out = absent(kind)
        for preset_name, parts in PRESETS.items():
            if kind in parts:
                on = {"enabled": True} if kind in COMPONENTS else {}
                out = F.when(known == preset_name, component(kind, **parts[kind], **on)).otherwise(out)
        return out

    return df.withColumns({kind: column(kind) for kind in (*COMPONENTS, *SETTINGS)})


def component_constants(catalog: DataFrame) -> DataFrame:
    """Add the normalisations of every component and the central potential ``psi0``."""
    h, b = F.col("halo"), F.col("bulge")
    psi0 = F.when(comp.enabled(h), h["v0"] * h["v0"]).when(comp.enabled(b), b["v0"] * b["v0"]).otherwise(0.0)
    return catalog.withColumns(
        {
            "halo_const": comp.halo_const(h),
            "disk_const": comp.surface_const(F.col("disk")),
            "disk2_const": comp.volume_const(F.col("disk2")),
            "gas_const": comp.surface_const(F.col("gas")),
            "bulge_const": comp.bulge_const(b),
            "psi0": psi0,
        }
    )


def halo_only(catalog: DataFrame) -> DataFrame:
    """Every baryonic component switched off."""
    return catalog.withColumns({c: F.col(c).withField("enabled", F.lit(False)) for c in BARYONS})


def baryons_only(catalog: DataFrame, grid: Mapping[str, float] | None = None) -> DataFrame:
    """The halo switched off; ``grid`` (dr, nr, lmax) replaces every model's grid."""
    out = catalog.withColumn("halo", F.col("halo").withField("enabled", F.lit(False)))
    return out if grid is None else out.withColumn("grid", component("grid", **grid))


def apply_fit(catalog: DataFrame, fits: DataFrame, *, keys: Sequence[str] = MODEL) -> DataFrame:
    """Write halo fits (v0, a, r_outer) into the catalog; models without a fit keep their halo.

    The outer radius only grows, and a model that had no halo gets one.
    """
    f = fits.select(*keys, F.struct("v0", "a", "r_outer").alias("__fit"))
    h, fit = F.col("halo"), F.col("__fit")
    fresh = component(
        "halo", r_outer=fit["r_outer"], v0=fit["v0"], a=fit["a"], dr_trunc=12.0, cusp=1.0, enabled=True
    )
    updated = component(
        "halo",
        r_outer=F.greatest(h["r_outer"], fit["r_outer"]),
        v0=fit["v0"],
        a=fit["a"],
        dr_trunc=h["dr_trunc"],
        cusp=h["cusp"],
        enabled=True,
    )
    out = catalog.join(f, list(keys), "left")
    return out.withColumn("halo", F.when(fit.isNull(), h).when(h.isNull(), fresh).otherwise(updated)).drop("__fit")
