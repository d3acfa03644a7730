"""From particles to fitted halos, and from halo plus baryons to forces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halocline.operators.fitting import fit_halo
from halocline.operators.harmonics import (
    harmonic_cells,
    merge_catalogs,
    merge_harmonics,
    midplane_radii,
    tagged_cells,
    tagged_decomposition,
)
from halocline.operators.models import MODEL, absent, apply_fit, component
from halocline.operators.multipoles import multipole_density, multipole_potential
from halocline.storage import materialise


def halo_from_particles(
    particles: DataFrame, catalog: DataFrame, *, keys: Sequence[str] = MODEL, **fit_options
) -> DataFrame:
    """Fit every model's halo particles (keyed like the catalog) and write the fits into it."""
    return apply_fit(catalog, fit_halo(particles, group_cols=list(keys), **fit_options), keys=keys)


def fixed_halo_superposition(
    halo: DataFrame,
    halo_catalog: DataFrame,
    baryon: DataFrame,
    baryon_catalog: DataFrame,
    *,
    lmax: int,
    n: int = 300,
    rmax: float = 100.0,
    bulge: DataFrame | None = None,
    keys: Sequence[str] = MODEL,
) -> DataFrame:
    """Midplane curves of baryons placed in a fixed halo: total, halo, bulge and disk speeds.

    ``bulge`` has the coefficients of the models' bulges alone, which ``baryon`` includes; without it, or for models that it lacks, ``v_bulge``
    is null and the bulge counts to the disk.
    """
    catalog = merge_catalogs(halo_catalog, baryon_catalog, keys=keys)
    parts = {"total": merge_harmonics(halo, baryon, keys=keys), "halo": halo}
    if bulge is not None:
        parts["bulge"] = bulge
    cells = tagged_cells({p: harmonic_cells(c, lmax, keys=keys) for p, c in parts.items()})
    radii = midplane_radii(catalog, n=n, rmax=rmax, keys=keys)
    return tagged_decomposition(radii, cells, catalog, lmax=lmax, keys=keys)


def superposition_from_particles(
    particles: DataFrame,
    *,
    dr: float,
    nr: int,
    lmax: int,
    halo: str = "halo",
    bulge: str = "bulge",
    n: int = 300,
    rmax: float = 100.0,
    component_col: str = "component",
    keys: Sequence[str] = MODEL,
    **particle_options,
) -> DataFrame:
    """The same curves straight from particles: every component's potential by its multipoles, and their sum.

    One pass over the particles gives the shells of all models and components; what is not halo or bulge counts to the disk.  Models
    without halo particles have no row, models without a bulge a null ``v_bulge``.
    """
    k = list(keys)
    by = [*k, component_col]
    shells = multipole_density(particles, dr=dr, nr=nr, lmax=lmax, group_cols=by, **particle_options)
    tables = materialise(multipole_potential(shells, dr=dr, nr=nr, group_cols=by), "component-harmonics")
    total = tables.groupBy(*k, "l", "ir", "r").agg(*[F.sum(v).alias(v) for v in ("adens", "apot", "fr")])
    alone = lambda c: tables.filter(F.col(component_col) == c).drop(component_col)
    cells = tagged_cells({p: harmonic_cells(c, lmax, keys=k) for p, c in (("total", total), ("halo", alone(halo)), ("bulge", alone(bulge)))})
    grid = component("grid", dr=dr, nr=nr, lmax=lmax)
    catalog = total.select(*k).distinct().select(*k, grid.alias("grid"), *[absent(c).alias(c) for c in ("disk", "disk2", "gas")])
    radii = midplane_radii(catalog, n=n, rmax=rmax, keys=k)
    return tagged_decomposition(radii, cells, catalog, lmax=lmax, analytic=False, keys=k)
