"""Centring, enclosed-mass fits and parameter scans for many objects at once."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halocline.operators.frames import POS
from halocline.operators.keys import attach, lookup_join
from halocline.operators.profiles import enclosed_mass
from halocline.storage import discard, materialise, scratch_path


AXES = range(3)
# A group of at most as many particles is centred by the task that it is dealt to, a larger one by rounds over all tasks.
LOCAL_ROWS = 1 << 18
BATCH_ROWS = 1 << 17  # fixed value: particles of whole groups that a task centres at a time
# Steps of a centre that its anchor allows for; more of them mean more rows in a round and fewer anchors.
STEPS_AHEAD = 8.0
LEAST_REACH = 0.25  # of the core radius
CENTRE, ANCHOR, INNER = (tuple(f"{n}{i}" for i in AXES) for n in ("__c", "__a", "__i"))


def _squared_distance(to: Sequence[str]) -> Column:
    d = [F.col(f"__p{i}") - F.col(to[i]) for i in AXES]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def _moments(rows: DataFrame, g: Sequence[str], inside: Column, about: Sequence[str]) -> DataFrame:
    """Mass and first moments about a point of the rows that are ``inside``; a group without any still has a row."""
    return rows.groupBy(*g).agg(
        F.sum(F.when(inside, F.col("__m"))).alias("__mass"),
        *[F.sum(F.when(inside, F.col("__m") * (F.col(f"__p{i}") - F.col(about[i])))).alias(f"__s{i}") for i in AXES],
    )


def _local_centres(mass: np.ndarray, pos: Sequence[np.ndarray], sizes: np.ndarray, core_radius: float, max_iter: int, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Centres of consecutive groups of ``sizes`` particles, and whether they settled; rounds go over those still open."""
    centre, settled = np.zeros((len(sizes), 3)), np.zeros(len(sizes), bool)
    now = np.arange(len(sizes))
    for _ in range(max(max_iter, 1)):
        d = [x - np.repeat(c, sizes) for x, c in zip(pos, centre[now].T)]
        inside = d[0] * d[0] + d[1] * d[1] + d[2] * d[2] < core_radius * core_radius
        begin = np.cumsum(sizes) - sizes
        total = np.add.reduceat(np.where(inside, mass, 0.0), begin)
        moments = [np.add.reduceat(np.where(inside, mass * x, 0.0), begin) for x in d]
        # as Spark compares: NaN is above zero
        step = np.column_stack([np.where(total <= 0, 0.0, s / total) for s in moments])
        still = (np.abs(step) < eps).all(axis=1)
        settled[now] = still
        centre[now[~still]] += step[~still]
        if still.all():
            break
        if still.any():
            open_ = np.repeat(~still, sizes)
            mass, pos, sizes, now = mass[open_], [x[open_] for x in pos], sizes[~still], now[~still]
    return centre, settled


def _centred_by_tasks(rows: DataFrame, g: Sequence[str], core_radius: float, max_iter: int, eps: float) -> DataFrame:
    """(g, centre, ``settled``) of groups that a task may hold: dealt and sorted by group, some groups at a time."""
    number = F.row_number().over(Window.partitionBy(*g).orderBy(F.lit(0)))
    values = [F.col(c).cast("double").alias(c) for c in ("__m", *(f"__p{i}" for i in AXES))]
    schema = T.StructType([*rows.select(*g).schema, *(T.StructField(c, T.DoubleType()) for c in CENTRE), T.StructField("settled", T.BooleanType())])

    def centred(held: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        column = lambda c, null: pc.fill_null(held[c], null).to_numpy()
        sizes = np.diff(starts, append=held.num_rows)
        with np.errstate(all="ignore"):
            centre, settled = _local_centres(column("__m", 0.0), [column(f"__p{i}", math.nan) for i in AXES], sizes, core_radius, max_iter, eps)
        out = held.select(list(g)).take(pa.array(starts))
        for name, values in zip((*CENTRE, "settled"), (*centre.T, settled)):
            out = out.append_column(name, pa.array(values))
        yield from out.combine_chunks().to_batches()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= BATCH_ROWS:
                table = pa.Table.from_batches(held)
                starts = np.flatnonzero(table["__first"].to_numpy())
                # the last group may go on
                last = int(starts[-1])
                if last:
                    yield from centred(table.slice(0, last), starts[:-1])
                held = table.slice(last).to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield from centred(table, np.flatnonzero(table["__first"].to_numpy()))

    return rows.select(*g, *values, (number == 1).alias("__first")).mapInArrow(scan, schema)


def core_center(
    df: DataFrame,
    *,
    core_radius: float = 10.0,
    max_iter: int = 20,
    tolerance: float = 0.001,
    mass: str = "mass",
    pos: Sequence[str] = POS,
    group_cols: Sequence[str] = (),
    local_rows: int = LOCAL_ROWS,
) -> DataFrame:
    """Offset of each group's dense core: columns ``cx, cy, cz, settled``.

    Each round averages the particles within ``core_radius`` of the current
    offset; a group is settled once its step is below ``tolerance * core_radius``
    on every axis or its core is empty or massless.  Masses and positions are stored
    once.  Groups of at most ``local_rows`` particles are dealt out by one exchange and go through
    their rounds in the task that holds them; larger ones, and a table without groups, take rounds of jobs over all particles
    (:func:`_centred_by_rounds`).
    """
    g = list(group_cols)
    eps = tolerance * core_radius
    spark = df.sparkSession
    kept = scratch_path(spark, "core-particles")
    rows = materialise(df.select(*g, F.col(mass).alias("__m"), *[F.col(c).alias(f"__p{i}") for i, c in enumerate(pos)]), "core-particles", kept)
    found = []
    if g:
        listed = scratch_path(spark, "core-large")
        large = materialise(rows.groupBy(*g).agg(F.count(F.lit(1)).alias("__rows")).filter(F.col("__rows") > local_rows).select(*g), "core-large", listed)
        most = large.count()
        small = lookup_join(rows, large, g, "left_anti", max_rows=most) if most else rows
        found.append(materialise(_centred_by_tasks(small, g, core_radius, max_iter, eps), "core-offsets"))
        if most:
            at_first = lookup_join(rows, large, g, "left_semi", max_rows=most)
            found.append(_centred_by_rounds(rows, at_first, g, most, core_radius, max_iter, eps))
        discard(spark, listed)
    else:
        found.append(_centred_by_rounds(rows, rows, g, 1, core_radius, max_iter, eps))
    discard(spark, kept)
    state = reduce(DataFrame.unionByName, found)
    return state.select(*g, *[F.col(c).alias(n) for c, n in zip(CENTRE, ("cx", "cy", "cz"))], "settled")


def _centred_by_rounds(rows: DataFrame, at_first: DataFrame, g: Sequence[str], most: int, core_radius: float, max_iter: int, eps: float) -> DataFrame:
    """(g, centre, ``settled``) of the at most ``most`` groups of ``at_first``, whose particles are among ``rows``.

    After the first round each group is anchored where it stands, with a reach of some of its steps: particles that are
    in the sphere from everywhere within reach count by their sums, those that are never in it are left, and rounds read only those that its surface may pass.
    A group that goes beyond its reach is anchored anew.  State is one row per group, in a written table that replaces the one before; the driver sees two
    counts a round.
    """
    spark = rows.sparkSession
    shells: list[tuple[str, T.StructType]] = []
    zero = F.lit(0.0)

    def distance(a: Sequence[str], b: Sequence[str]) -> Column:
        d = [F.col(x) - F.col(y) for x, y in zip(a, b)]
        return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])

    def anchor(state: DataFrame) -> DataFrame:
        """The state with the groups that are beyond their reach anchored where they are; their shells are stored beside the older ones."""
        number = len(shells)
        reach = F.greatest(F.least(F.col("__step") * STEPS_AHEAD, F.lit(core_radius * 0.5)), F.lit(core_radius * LEAST_REACH))
        gone = state.filter("__gone").select(*g, *CENTRE, reach.alias("__new_reach")).withColumnRenamed("__new_reach", "__reach")
        placed = attach(rows, gone, g, max_rows=most).withColumn("__far", F.sqrt(_squared_distance(CENTRE)))
        # a little more than the reach, so that rounding can't part what belongs together
        wide = F.col("__reach") * (1 + 1e-9) + 1e-9 * core_radius
        shell = placed.filter((F.col("__far") >= core_radius - wide) & (F.col("__far") < core_radius + wide))
        path = scratch_path(spark, "core-shell")
        own = shell.select(*g, F.lit(number).alias("__n"), "__m", *[f"__p{i}" for i in AXES])
        shells.append((path, own.schema))
        materialise(own, "core-shell", path)
        inner = _moments(placed, g, F.col("__far") < core_radius - wide, CENTRE).select(
            *g, F.col("__mass").alias("__mass_new"), *[F.col(f"__s{i}").alias(f"__s{i}_new") for i in AXES]
        )
        out = attach(state, inner, g, "left", max_rows=most)
        new = {"__reach": reach, "__n": F.lit(number), "__i": F.coalesce("__mass_new", zero)}
        new |= {ANCHOR[i]: F.col(CENTRE[i]) for i in AXES} | {INNER[i]: F.coalesce(f"__s{i}_new", zero) for i in AXES}
        return out.select(*g, *CENTRE, "settled", *[F.when(F.col("__gone"), v).otherwise(F.col(c)).alias(c) for c, v in new.items()])

    def moments(state: DataFrame) -> DataFrame:
        """The state with mass and moments about each open group's centre of what lies in its sphere."""
        shell = spark.read.schema(shells[0][1]).parquet(*[path for path, _ in shells])
        now = state.filter(~F.col("settled")).select(*g, *CENTRE, "__n")
        # of a group's shells the one of its latest anchor counts
        placed = attach(shell.withColumnRenamed("__n", "__of"), now, g, max_rows=most).filter(F.col("__of") == F.col("__n"))
        cut = _moments(placed, g, _squared_distance(CENTRE) < core_radius * core_radius, CENTRE)
        out = attach(state, cut, g, "left", max_rows=most)
        sums = {"__mass": F.col("__i") + F.coalesce("__mass", zero)}
        for i in AXES:
            sums[f"__s{i}"] = F.col(INNER[i]) + F.col("__i") * (F.col(ANCHOR[i]) - F.col(CENTRE[i])) + F.coalesce(f"__s{i}", zero)
        return out.withColumns(sums)

    carried = ["__reach", "__n", "__i", *ANCHOR, *INNER]
    counts = {"open": F.count_if(~F.col("settled")), "gone": F.count_if(F.col("__gone"))}
    last: list[str] = []

    def advance(state: DataFrame) -> tuple[DataFrame, dict]:
        """Centres moved by their moments, stored, with the counts of open groups and of those beyond their reach."""
        move = [F.coalesce(F.when(F.col("__mass") > 0, F.col(f"__s{i}") / F.col("__mass")), zero) for i in AXES]
        out = state.withColumns({f"__v{i}": m for i, m in enumerate(move)})
        still = F.lit(True)
        for i in AXES:
            still = still & (F.abs(F.col(f"__v{i}")) < eps)
        out = out.withColumn("__still", F.col("settled") | still)
        length = F.sqrt(F.col("__v0") * F.col("__v0") + F.col("__v1") * F.col("__v1") + F.col("__v2") * F.col("__v2"))
        out = out.withColumns({c: F.when(F.col("__still"), F.col(c)).otherwise(F.col(c) + F.col(f"__v{i}")) for i, c in enumerate(CENTRE)} | {"__step": length})
        out = out.withColumn("__gone", ~F.col("__still") & ~F.coalesce(distance(CENTRE, ANCHOR) <= F.col("__reach"), F.lit(False)))
        out = out.select(*g, *CENTRE, F.col("__still").alias("settled"), "__step", "__gone", *carried)
        seen, path = Observation(), scratch_path(spark, "core-offsets")
        out = materialise(out.observe(seen, *[c.alias(n) for n, c in counts.items()]), "core-offsets", path)
        if last:
            discard(spark, last.pop())
        last.append(path)
        return out, seen.get

    none = F.lit(None).cast("double")
    at_zero = at_first.withColumns({c: F.lit(0.0) for c in CENTRE})
    state = _moments(at_zero, g, _squared_distance(CENTRE) < core_radius * core_radius, CENTRE)
    state = state.withColumns({c: F.lit(0.0) for c in CENTRE} | {"settled": F.lit(False), "__n": F.lit(-1)} | {c: none for c in carried if c != "__n"})
    state, seen = advance(state)
    for _ in range(max_iter - 1):
        if not seen["open"]:
            break
        state, seen = advance(moments(anchor(state) if seen["gone"] else state))
    for path, _ in shells:
        discard(spark, path)
    return state.select(*g, *CENTRE, "settled")


def center_on_core(
    df: DataFrame, *, pos: Sequence[str] = POS, group_cols: Sequence[str] = (), settled: str | None = None, **options
) -> DataFrame:
    """Positions relative to the dense core of each group (see :func:`core_center`).

    ``settled`` names a column that tells whether the group's centre settled within the rounds allowed.
    """
    offsets = core_center(df, pos=pos, group_cols=group_cols, **options)
    offsets = offsets.withColumnRenamed("settled", settled) if settled else offsets.drop("settled")
    out = attach(df, offsets, group_cols)
    shift = zip(pos, ("cx", "cy", "cz"))
    return out.withColumns({p: F.col(p) - F.col(c) for p, c in shift}).drop("cx", "cy", "cz")


FIT_TIE = 1e-12


def _nfw_search(r: list, m: list, steps: int, refinements: int) -> np.ndarray:
    """(a, m_scale, rms) per profile by a narrowing ladder in ln a; profiles are padded to one width."""
    width = max(map(len, r))
    used = np.array([[i < len(p) for i in range(width)] for p in r])
    radius, mass = np.ones(used.shape), np.zeros(used.shape)
    radius[used], mass[used] = np.concatenate(r), np.concatenate(m)

    def shape(x):
        return np.log1p(x) - x / (1.0 + x)

    lo = np.log(np.where(used, radius, np.inf).min(axis=1) * 0.5)
    hi = np.log(np.where(used, radius, 0.0).max(axis=1) * 2.0)
    rows = np.arange(len(r))
    for _ in range(refinements + 1):
        ladder = lo[:, None] + np.arange(steps + 1) * (hi - lo)[:, None] / steps
        f = shape(radius[:, None, :] / np.exp(ladder)[:, :, None]) * used[:, None, :]
        # least squares in the mass scale, then the residual left over
        mf, ff = (f * mass[:, None, :]).sum(axis=2), (f * f).sum(axis=2)
        total = (mass * mass).sum(axis=1)[:, None]
        left = total - mf * mf / ff
        tied = left <= left.min(axis=1, keepdims=True) + FIT_TIE * total
        best = ladder[rows, np.argmax(tied, axis=1)]
        step = (hi - lo) / steps
        lo, hi = np.maximum(lo, best - step), np.minimum(hi, best + step)
    a = np.exp(best)
    f = shape(radius / a[:, None]) * used
    scale = (mass * f).sum(axis=1) / (f * f).sum(axis=1)
    off = np.where(used, scale[:, None] * f / np.where(used, mass, 1.0) - 1.0, 0.0)
    return np.column_stack([a, scale, np.sqrt((off * off).sum(axis=1) / used.sum(axis=1))])


def nfw_fit(
    profile: DataFrame,
    *,
    group_cols: Sequence[str] = (),
    steps: int = 64,
    refinements: int = 4,
    radius_at: str = "center",
    strict: bool = False,
) -> DataFrame:
    """Least-squares NFW mass law per enclosed-mass profile.

    For a given scale radius the best mass scale is linear, so only ``a`` is
    searched: ``steps`` logarithmic steps over [r_min/2, 2 r_max], then
    ``refinements`` times between the neighbours of the best step.  Residuals within
    ``FIT_TIE`` of the masses' own square sum are a tie, which the smaller radius
    takes: closer ones differ by the order of summing only.  A profile has
    at most ``n_bins`` rows per group and is held as an array, so a batch of
    objects is searched at once in numpy.  Fewer than three bins give no row, or an
    error when ``strict``.  ``radius_at='edge'`` pairs masses with the bins' outer
    edges instead of their centres.
    """
    g = list(group_cols)
    radius = {"center": "r", "edge": "r_edge"}[radius_at]
    point = F.struct(F.col(radius).cast("double").alias("r"), F.col("m_enc").cast("double").alias("m"))
    fits = profile.filter(F.col("m_enc") > 0).groupBy(*g).agg(
        F.sort_array(F.collect_list(point)).alias("__pts"), F.max("r_max").alias("r_outer")
    )
    enough = F.size("__pts") >= 3
    if strict:
        none = F.raise_error(F.concat(F.lit("fewer than three bins with mass in group "), F.to_json(F.struct(*g)) if g else F.lit("(all)"))).cast(fits.schema["__pts"].dataType)
        fits = fits.withColumn("__pts", F.when(enough, F.col("__pts")).otherwise(none))
    else:
        fits = fits.filter(enough)

    @F.pandas_udf("struct<a:double,m_scale:double,rms_residual:double>")
    def search(r: pd.Series, m: pd.Series) -> pd.DataFrame:
        chunk = 256
        parts = [
            _nfw_search(list(r[i : i + chunk]), list(m[i : i + chunk]), steps, refinements)
            for i in range(0, len(r), chunk)
        ]
        return pd.DataFrame(np.concatenate(parts), columns=["a", "m_scale", "rms_residual"])

    column = lambda name: F.transform("__pts", lambda p: p[name])
    fits = fits.select(*g, "r_outer", search(column("r"), column("m")).alias("__fit")).select(*g, "r_outer", "__fit.*")
    v_circ = F.sqrt(F.col("m_scale") * (math.log(3.0) - 2.0 / 3.0) / (F.col("a") * 2.0))
    v0 = F.when(v_circ > 0, v_circ / math.sqrt(math.log(3.0) / 2.0)).otherwise(1.0)
    return fits.select(*g, v0.alias("v0"), "a", "r_outer", "m_scale", "rms_residual")


def fit_halo(
    df: DataFrame,
    *,
    center: bool = True,
    core_radius: float = 10.0,
    max_iter: int = 20,
    n_bins: int = 40,
    group_cols: Sequence[str] = (),
    mass: str = "mass",
    pos: Sequence[str] = POS,
    strict: bool = False,
    **fit_options,
) -> DataFrame:
    """Centre on the core, bin the enclosed mass, fit."""
    if center:
        df = center_on_core(
            df, core_radius=core_radius, max_iter=max_iter, group_cols=group_cols, mass=mass, pos=pos
        )
    profile = enclosed_mass(df, n_bins=n_bins, mass=mass, pos=pos, group_cols=group_cols, strict=strict)
    return nfw_fit(profile, group_cols=group_cols, strict=strict, **fit_options)


MASS_COMPONENTS = ("disk", "bulge", "halo")


def wide_component_masses(
    masses: DataFrame,
    *,
    group_cols: Sequence[str] = ("galaxy_id",),
    component: str = "component",
    mass: str = "mass",
    radius: str = "radius",
) -> DataFrame:
    """One row per group from long rows ``(group, component, mass, radius)``, as :func:`rotation_curve_scale` takes them.

    A component that is not listed has null mass; one listed several times has the sum of its masses.  The
    halo's largest radius is kept; other components are left out.
    """
    own = lambda name, value: F.when(F.col(component) == name, F.col(value))
    return masses.groupBy(*group_cols).agg(
        *[F.sum(own(c, mass)).alias(f"mass_{c}") for c in MASS_COMPONENTS],
        F.max(own("halo", radius)).alias("radius_halo"),
    )


def rotation_curve_scale(
    compared: DataFrame,
    masses: DataFrame | None = None,
    *,
    group_cols: Sequence[str] = ("galaxy_id",),
    v_model: str = "v_model",
    v_obs: str = "V_kms",
    sigma: str = "sigma_kms",
    G_msun: float = 4.3e-6,
    velocity_kms: float = 100.0,
) -> DataFrame:
    """Velocity scale between model and observed curves with the weighted rms, in one aggregate.

    ``masses`` has ``mass_disk, mass_bulge, mass_halo, radius_halo`` per group, or long rows
    ``(group, component, mass, radius)`` as the mass files give them; with it the component masses
    in solar units are added.  A mass that is absent, or a group without masses, counts as 0.
    """
    v = F.col(v_model)
    o = F.col(v_obs) / velocity_kms
    s = F.col(sigma) / velocity_kms
    sums = compared.groupBy(*group_cols).agg(
        F.sum(v * o).alias("__vo"),
        F.sum(v * v).alias("__vv"),
        F.avg(v * v / (s * s)).alias("__cvv"),
        F.avg(v * o / (s * s)).alias("__cvo"),
        F.avg(o * o / (s * s)).alias("__coo"),
        F.count(F.lit(1)).alias("n"),
    )
    sums = sums.withColumn("v_scale", F.try_divide(F.col("__vo"), F.col("__vv")))
    k = F.col("v_scale")
    ms = k * k * F.col("__cvv") - k * F.col("__cvo") * 2.0 + F.col("__coo")
    out = sums.withColumn("rms", F.sqrt(F.greatest(ms, F.lit(0.0)))).select(*group_cols, "n", "v_scale", "rms")
    if masses is None:
        return out
    if "component" in masses.columns:
        masses = wide_component_masses(masses, group_cols=group_cols)
    out = out.join(masses, list(group_cols), "left")
    to_msun = k * k / G_msun
    return out.withColumns(
        {f"{c}_mass_msun": F.coalesce(F.col(f"mass_{c}"), F.lit(0.0)) * to_msun for c in MASS_COMPONENTS}
    ).withColumnRenamed("radius_halo", "halo_radius_kpc").drop("mass_disk", "mass_bulge", "mass_halo")


# grid points whose sums one aggregate keeps side by side
GRID_BLOCK = 32


def _pull_squared(value: Column, observed: str, sigma: str) -> Column:
    pull = (value - F.col(observed)) / F.col(sigma)
    return pull * pull


def parameter_scan(
    df: DataFrame,
    model: Callable[[Mapping[str, Column]], Column],
    bounds: Mapping[str, tuple[float, float]],
    *,
    observed: str,
    sigma: str,
    steps: int = 8,
    refinements: int = 0,
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Least chi-squared of ``model(params)`` over a parameter grid, per group.

    A row updates one sum per grid point, ``GRID_BLOCK`` of them side by side, and only
    sums are shuffled.  Refinement repeats the scan between the neighbours of each
    group's best point.
    """
    g = list(group_cols)
    names = list(bounds)
    points = (steps + 1) ** len(names)

    def place(j: Column, lo: Mapping[str, Column], hi: Mapping[str, Column]) -> dict[str, Column]:
        digits = {p: (steps + 1) ** i for i, p in enumerate(reversed(names))}
        number = {p: F.pmod(F.floor(j / digits[p]), F.lit(steps + 1)) for p in names}
        return {p: lo[p] + (hi[p] - lo[p]) * number[p] / steps for p in names}

    lo = {p: F.lit(float(bounds[p][0])) for p in names}
    hi = {p: F.lit(float(bounds[p][1])) for p in names}
    best = None
    for level in range(refinements + 1):
        rows = df
        if best is not None:
            rows = attach(df, best.select(*g, *[F.col(p).alias(f"__c_{p}") for p in names]), g)
            for p in names:
                half = (bounds[p][1] - bounds[p][0]) / steps * (2.0 / steps) ** (level - 1)
                lo[p] = F.greatest(F.lit(float(bounds[p][0])), F.col(f"__c_{p}") - half)
                hi[p] = F.least(F.lit(float(bounds[p][1])), F.col(f"__c_{p}") + half)
        # point number j of the grid, last parameter fastest; a row meets it in block j // GRID_BLOCK
        blocks = -(-points // GRID_BLOCK)
        rows = rows.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        sums = rows.groupBy(*g, "__block").agg(
            F.count(F.lit(1)).alias("n"),
            *[F.first(end[p]).alias(f"__{e}_{p}") for e, end in (("lo", lo), ("hi", hi)) for p in names],
            *[
                F.sum(_pull_squared(model(place(F.col("__block") * GRID_BLOCK + i, lo, hi)), observed, sigma)).alias(f"__{i}")
                for i in range(min(GRID_BLOCK, points))
            ],
        )
        chi2 = F.array(*[F.col(f"__{i}") for i in range(min(GRID_BLOCK, points))])
        sums = sums.select("*", F.posexplode(chi2).alias("__i", "chi2"))
        sums = sums.withColumn("__j", F.col("__block") * GRID_BLOCK + F.col("__i")).filter(F.col("__j") < points)
        # ties go to the lowest grid point
        ends = [f"__{e}_{p}" for e in ("lo", "hi") for p in names]
        best = sums.groupBy(*g).agg(F.min(F.struct("chi2", "__j", *ends, "n")).alias("__b")).select(*g, "__b.*")
        found = place(F.col("__j"), *[{p: F.col(f"__{e}_{p}") for p in names} for e in ("lo", "hi")])
        best = best.select(*g, *[found[p].alias(p) for p in names], "chi2", "n")
        if level < refinements:
            best = materialise(best, "scan")
    return best
