"""Impossible, stuck and spiking readings, per source against its own normal behaviour.

Method: peaks over threshold.  The residual of a reading is its distance to the nearer of
the levels just before and just after it, in units of the source's usual change, divided by
the scale of its hour of day (seasonal residual).  Above the 90th percentile of a source its
residuals follow a generalized Pareto law, which is fitted by maximum likelihood; what lies
beyond the 97th percentile enters as "larger than that", so spikes in the tail cannot
pull the fit.  A fixed risk gives the tail cutoff, and a reading beyond it is a spike.  Every
source is fitted by itself, with what all sources of its kind have in common as a prior (each
of them with the same say): a fixed weight of their residuals and a normal law around the
shape of their tail.  The prior
decides where a source has few readings and fades where it has many.  Rules are added for
stuck readings; impossible ones are plain predicates.

Scale: the readings of all sources are cut by range of (source, time) into even slices, a
hot source over several, and each slice is read once in order by vectorized code with a
bounded buffer.  The same pass counts, per task, what the statistics need: changes by value
and residuals on a logarithmic grid.  The readings at each border of two slices are finished
together, a few rows per border.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.skew import value_frequencies, weighted_profile
from millrace.plans import broadcast_if_small, durable

#: Readings on either side that make up a level.
LEVEL = 5
#: Share of the residuals that is no tail, and of those whose size the fit looks at.
_BULK, _SEEN = 0.9, 0.97
#: Weight, in residuals, of all sources of a kind in the fit of one of them.
POOL_WEIGHT = 400.0
#: Standard deviation of the sources' shapes around that of their kind, and bounds of a shape (a third moment exists).
SHAPE_SPREAD = 0.1
_LEAST_SHAPE, _MOST_SHAPE = -0.5, 1 / 3
_BLOCK = 100_000
_MICROS_PER_HOUR = 3_600_000_000
#: Sources whose few statistics are sent to every executor; beyond, they are joined.
_SMALL = 100_000
_STEP = float(np.log(1.01))
#: What a row of a slice's result is.
READING, SEAM, CHANGE, STUCK, EDGE, COUNT, SIZE, PIECE = range(8)


def flag_readings(
    readings: DataFrame,
    *,
    by: Sequence[str],
    kind: str,
    time: str,
    id: str,
    values: Sequence[str],
    others: Mapping[str, str] | None = None,
    stuck: tuple[int, int] | Mapping[str, tuple[int, int]] = (20, 10),
    risk: float = 1e-5,
) -> DataFrame:
    """The readings that are a spike or stuck: ``by``, ``field``, ``id``, ``spike``, ``stuck``, ``changes``, ``residual`` and ``cutoff``.

    A source is one of ``values`` of one combination of ``by``, of which ``kind`` is one
    column with a handful of values; sources of one kind and field share a part of the fit.
    Order is ``time`` (microseconds), then ``id``.

    * spike: the seasonal residual exceeds the tail cutoff at ``risk``.  ``changes`` is the
      distance to the nearer level in usual changes, before the season is taken out.  A level
      is the median of the valid ones of the ``LEVEL`` readings next to a reading, so an
      excursion of up to three readings counts and a lasting new level doesn't.  The usual
      change is the median of the changes that aren't zero; a source without any has no
      spikes.  Distances are exact to 2**-44 of the reading.
    * stuck: one of at least so many consecutive readings of exactly one value while the
      field that ``others`` names takes at least so many different values; ``stuck`` has both
      numbers, or a pair for each value of ``kind``.  Without an other field the second number
      doesn't count.
    * null values and rows with a null in ``by``, ``time`` or ``id`` are skipped and don't
      interrupt a run; zero, negative, NaN and infinite values are never part of a level nor
      spikes; NaN is never stuck; rows that repeat ``by``, ``time`` and ``id`` count once;
      other columns aren't read; an empty table gives no rows.
    """
    by, values = list(by), list(values)
    ks = [f"k{j}" for j in range(len(by))]
    vs = [f"v{j}" for j in range(len(values))]
    narrow = readings.select(
        *[F.col(c).alias(k) for k, c in zip(ks, by)],
        F.col(time).cast("long").alias("t"),
        F.col(id).cast("long").alias("i"),
        *[F.col(c).cast("double").alias(v) for v, c in zip(vs, values)],
    )
    narrow = narrow.filter(" and ".join(f"{c} is not null" for c in [*ks, "t", "i"])).filter(F.coalesce(*vs).isNotNull())
    order = [*ks, "t", "i"]
    key_fields = [T.StructField(k, narrow.schema[k].dataType) for k in ks]
    schema = T.StructType(
        [T.StructField("what", T.IntegerType()), *key_fields]
        + [T.StructField(c, t) for c, t in (("f", T.IntegerType()), ("i", T.LongType()), ("hour", T.IntegerType()), ("x", T.DoubleType()), ("w", T.LongType()), ("slice", T.LongType()), ("pos", T.LongType()), ("edge", T.IntegerType()), ("seen", T.ArrayType(T.DoubleType())))]
    )
    other_of = [values.index(others[v]) if others and v in others else -1 for v in values]
    rule = stuck if isinstance(stuck, Mapping) else {None: stuck}
    slices = narrow.repartitionByRange(*order).sortWithinPartitions(*order)
    read = durable(slices.mapInArrow(_Slice(ks, ks.index(ks[by.index(kind)]), len(vs), other_of, dict(rule)), schema))

    seams = durable(_seams(read, ks, key_fields))
    source = [*ks, "f"]
    grid = F.round(F.log("dist") / _STEP).cast("long")
    changes = read.filter(F.col("what") == CHANGE).select(*source, "x", "w").unionByName(seams.filter("step > 0").select(*source, F.col("step").alias("x"), F.lit(1).cast("long").alias("w")))
    usual = weighted_profile(changes.groupBy(*source, "x").agg(F.sum("w").alias("weight")), source, "x", percentiles=[0.5])
    usual = durable(usual.select(*source, F.col("p50").alias("usual")))
    counts = read.filter(F.col("what") == COUNT).select(*source, "hour", "pos", "w").unionByName(seams.filter("dist > 0").select(*source, "hour", grid.alias("pos"), F.lit(1).cast("long").alias("w")))
    counts = counts.groupBy(*source, "hour", "pos").agg(F.sum("w").alias("w")).join(broadcast_if_small(usual, _SMALL), source)
    limits = durable(_limits(durable(counts), source, ks[by.index(kind)], risk, _residual_season))
    distances = read.filter(F.col("what") == READING).select(*source, "i", "hour", F.col("x").alias("dist")).unionByName(seams.filter("dist > 0").select(*source, "i", "hour", "dist"))
    over = distances.join(broadcast_if_small(limits, _SMALL), source).withColumn("season", F.element_at("seasons", F.col("hour") + 1))
    over = over.withColumn("changes", F.col("dist") / F.col("usual")).withColumn("residual", F.col("changes") / F.col("season")).filter("residual > cutoff")
    spikes = over.select(*source, "i", F.lit(True).alias("spike"), F.lit(False).alias("stuck"), "changes", "residual", "cutoff")
    none = F.lit(None).cast("double")
    held = _stuck(read, ks, [*by][by.index(kind)], ks[by.index(kind)], other_of, rule).select(*source, "i", F.lit(False).alias("spike"), F.lit(True).alias("stuck"), none.alias("changes"), none.alias("residual"), none.alias("cutoff"))
    flags = (
        spikes.unionByName(held)
        .groupBy(*source, "i")
        .agg(F.bool_or("spike").alias("spike"), F.bool_or("stuck").alias("stuck"), *[F.max(c).alias(c) for c in ("changes", "residual", "cutoff")])
    )
    names = F.array(*[F.lit(v) for v in values])
    return flags.select(*[F.col(k).alias(c) for k, c in zip(ks, by)], F.element_at(names, F.col("f") + 1).alias("field"), F.col("i").alias(id), "spike", "stuck", "changes", "residual", "cutoff")


def flag_magnitudes(rows: DataFrame, *, by: Sequence[str], time: str, id: str, value: str, risk: float = 1e-5) -> DataFrame:
    """Rows whose positive ``value`` is unusually large for their source: ``by``, ``id``, ``times`` the median, ``residual``, ``cutoff``.

    The residual is the logarithm of value to the source's median, less the mean of its hour
    of day; the tail cutoff is that of ``flag_readings``.  Null values and rows with nulls in
    ``by``, ``time`` or ``id`` are skipped; NaN, infinite, zero and negative values are neither
    judged nor part of the tail, but all non-null values count for the median.
    """
    by = list(by)
    ks = [f"k{j}" for j in range(len(by))]
    narrow = rows.select(*[F.col(c).alias(k) for k, c in zip(ks, by)], F.hour(F.timestamp_micros(F.col(time))).alias("hour"), F.col(id).alias("i"), F.col(value).alias("v"))
    narrow = durable(narrow.filter(" and ".join(f"{c} is not null" for c in [*ks, "hour", "i", "v"])))
    middle = weighted_profile(value_frequencies(narrow, ks, "v"), ks, "v", percentiles=[0.5])
    middle = durable(middle.filter("p50 > 0").select(*ks, F.col("p50").alias("usual")))
    x = F.col("v").cast("double")
    ratios = narrow.filter((x > 0) & (x < float("inf"))).join(broadcast_if_small(middle, _SMALL), ks).withColumn("times", x / F.col("usual"))
    counts = ratios.groupBy(*ks, "hour", "usual", F.round(F.log("times") / _STEP).cast("long").alias("pos")).agg(F.count(F.lit(1)).alias("w"))
    limits = durable(_limits(durable(counts.withColumn("f", F.lit(0))), [*ks, "f"], None, risk, _ratio_season)).drop("f", "usual")
    over = ratios.join(broadcast_if_small(limits, _SMALL), ks).withColumn("residual", F.log("times") - F.element_at("seasons", F.col("hour") + 1)).filter("residual > cutoff")
    return over.select(*[F.col(k).alias(c) for k, c in zip(ks, by)], F.col("i").alias(id), "times", "residual", "cutoff")


def fit_tail(level: np.ndarray, weight: np.ndarray, prior: float | None = None) -> tuple[float, float, float, float, float]:
    """Generalized Pareto law of the excesses over the 90th percentile: (threshold, tail share, scale, shape, standard error of the shape).

    Maximum likelihood on a grid of the shape and of ``theta = shape / scale``; excesses beyond
    the 97th percentile are censored there.  ``prior`` is the shape around which that of the
    source is expected, ``SHAPE_SPREAD`` off.  Scale 0 where there is no excess.
    """
    order = np.argsort(level, kind="stable")
    level, weight = level[order], weight[order]
    upto = np.cumsum(weight)
    n = upto[-1]
    u = level[min(np.searchsorted(upto, n * _BULK), len(level) - 1)]
    c = level[min(np.searchsorted(upto, n * _SEEN), len(level) - 1)] - u
    tail = level > u
    share = weight[tail].sum() / n
    y, w = level[tail] - u, weight[tail]
    if not len(y) or c <= 0:
        return float(u), float(share), 0.0, 0.0, 0.0
    seen = y <= c
    y, w, hidden = y[seen], w[seen], w[~seen].sum()
    m = w.sum()
    mean = (w @ y) / m
    theta = np.concatenate([-np.geomspace(0.95, 1e-3, 64) / c, np.geomspace(1e-3, 30, 64) / mean])
    shape = np.concatenate([-np.geomspace(-_LEAST_SHAPE, 1e-3, 48), np.geomspace(1e-3, _MOST_SHAPE, 48)])
    for finer in (False, True):
        logs = (np.log1p(theta[:, None] * y[None, :]) @ w)[:, None]
        far = np.log1p(theta * c)[:, None]
        with np.errstate(invalid="ignore"):
            fits = -m * np.log(shape / theta[:, None]) - (1 + 1 / shape) * logs - hidden / shape * far
        if prior is not None:
            fits -= (shape - prior) ** 2 / (2 * SHAPE_SPREAD**2)
        fits = np.where(np.isfinite(fits), fits, -np.inf)
        at, best = np.unravel_index(int(fits.argmax()), fits.shape)
        xi, there = float(shape[best]), float(theta[at])
        if not finer:
            share_of = np.exp(fits - fits.max()).sum(axis=0) * np.abs(np.gradient(shape))
            share_of /= share_of.sum()
            spread = float(np.sqrt(share_of @ (shape - share_of @ shape) ** 2))
            theta = there * np.geomspace(0.85, 1.18, 64)
            theta = theta[theta * c > -1]
            shape = np.clip(xi * np.geomspace(0.85, 1.18, 48), _LEAST_SHAPE, _MOST_SHAPE)
    return float(u), float(share), xi / there, xi, max(spread, (1 + xi) / float(np.sqrt(n)))


def tail_cutoff(fit: tuple[float, float, float, float, float], risk: float) -> float:
    """The level that a share ``risk`` of all residuals exceeds under the fitted law."""
    u, share, scale, shape, _ = fit
    if not scale or share <= risk:
        return u
    return u + scale / shape * ((risk / share) ** -shape - 1) if abs(shape) > 1e-9 else u - scale * float(np.log(risk / share))


def _residual_season(level: np.ndarray, weight: np.ndarray, hour: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean residual of each hour against that of the day, outliers cut, shrunk towards 1 where there are few; the residuals without it."""
    cut = np.minimum(level, 10.0) * weight
    total, n = np.bincount(hour, cut, 24), np.bincount(hour, weight, 24)
    mean = cut.sum() / weight.sum()
    season = (total + mean * 30) / (n + 30) / mean
    return season, level / season[hour]


def _ratio_season(level: np.ndarray, weight: np.ndarray, hour: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean logarithm of each hour, shrunk towards 0; the positive residuals without it."""
    logs = np.log(level)
    season = np.bincount(hour, logs * weight, 24) / (np.bincount(hour, weight, 24) + 30)
    return season, np.maximum(logs - season[hour], 0.0)


def _limits(counts: DataFrame, source: list[str], kind: str | None, risk: float, season_of) -> DataFrame:
    """Usual change, seasons (one per hour) and cutoff of every source of ``counts`` (``source``, ``hour``, ``pos``, ``w``, ``usual``).

    A source has at most as many rows here as hours times steps of the grid.
    """
    pool = [kind, "f"] if kind else ["f"]
    scaled = F.col("pos") - F.round(F.log("usual") / _STEP).cast("long") if season_of is _residual_season else F.col("pos")
    # every source has the same say, or a hot one would be the rule for all; rows: kinds x fields x steps of the grid
    share = F.col("w") / F.sum("w").over(Window.partitionBy(*source))
    pooled = counts.select(*pool, scaled.alias("pos"), share.alias("w")).groupBy(*pool, "pos").agg(F.sum("w").alias("w")).toPandas()
    prior = {}
    for key, g in pooled.groupby(pool, sort=False):
        level, weight = np.exp(g["pos"].to_numpy() * _STEP), g["w"].to_numpy(dtype="float64")
        _, level = season_of(level, weight, np.zeros(len(level), dtype=np.int64))
        prior[key] = (level, weight * POOL_WEIGHT / weight.sum(), fit_tail(level, weight)[3])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _per_source(batches, source):
            key = {k: table.column(k)[0].as_py() for k in source}
            usual = table.column("usual")[0].as_py()
            level, weight, hour = np.exp(table.column("pos").to_numpy() * _STEP), table.column("w").to_numpy().astype("float64"), table.column("hour").to_numpy()
            if season_of is _residual_season:
                level = level / usual
            season, level = season_of(level, weight, hour)
            more, pseudo, shape = prior[tuple(key[k] for k in pool)]
            cutoff = tail_cutoff(fit_tail(np.concatenate([level, more]), np.concatenate([weight, pseudo]), shape), risk)
            columns = [pa.array([v], table.schema.field(k).type) for k, v in key.items()]
            columns += [pa.array([float(usual)]), pa.array([season.tolist()], pa.list_(pa.float64())), pa.array([cutoff])]
            yield pa.record_batch(columns, names=[*source, "usual", "seasons", "cutoff"])

    kinds = [T.StructField(k, counts.schema[k].dataType) for k in source]
    schema = T.StructType([*kinds, T.StructField("usual", T.DoubleType()), T.StructField("seasons", T.ArrayType(T.DoubleType())), T.StructField("cutoff", T.DoubleType())])
    return counts.repartition(*source).sortWithinPartitions(*source).mapInArrow(fit, schema)


def _per_source(batches: Iterator[pa.RecordBatch], source: list[str]) -> Iterator[pa.Table]:
    """The rows of each source of batches that are sorted by source."""
    held: pa.Table | None = None
    for b in batches:
        rows = pa.Table.from_batches([b])
        rows = (rows if held is None else pa.concat_tables([held, rows])).combine_chunks()
        if not rows.num_rows:
            continue
        new = np.zeros(rows.num_rows, dtype=bool)
        for k in source:
            at = rows.column(k).combine_chunks().dictionary_encode()
            at = (at.chunk(0) if isinstance(at, pa.ChunkedArray) else at).indices.fill_null(-1).to_numpy()
            new[1:] |= at[1:] != at[:-1]
        starts = np.append(0, np.flatnonzero(new))
        for a, z in zip(starts[:-1].tolist(), starts[1:].tolist()):
            yield rows.slice(a, z - a)
        held = rows.slice(int(starts[-1]))
    if held is not None and held.num_rows:
        yield held


def _seams(read: DataFrame, ks: list[str], key_fields: list[T.StructField]) -> DataFrame:
    """Distance and step of the readings at slice ends: every border with the readings on both sides of it.

    A slice with fewer readings than a border needs belongs to the border before it whole.
    """
    sizes = read.filter(F.col("what") == SIZE).select("f", "slice", (F.col("w") >= 2 * LEVEL).cast("long").alias("long"))
    # one row per slice and field
    border = F.sum("long").over(Window.partitionBy("f").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0))
    borders = sizes.select("f", "slice", border.alias("border"))
    rows = read.filter(F.col("what") == SEAM).select(*ks, "f", "i", "hour", "x", "w", "slice", "pos", "edge").join(broadcast_if_small(borders, _SMALL), ["f", "slice"])
    rows = rows.withColumn("border", F.col("border") - (F.col("edge") == 1).cast("long"))
    schema = T.StructType([*key_fields, T.StructField("f", T.IntegerType()), T.StructField("i", T.LongType()), T.StructField("hour", T.IntegerType()), T.StructField("dist", T.DoubleType()), T.StructField("step", T.DoubleType())])

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["slice", "pos"], kind="stable").reset_index(drop=True)
        change = np.zeros(len(pdf), dtype=bool)
        for k in ks:
            change |= (pdf[k] != pdf[k].shift()).to_numpy()
        dist, step = residuals(pdf["x"].to_numpy(dtype="float64"), np.cumsum(change))
        pdf = pdf.assign(dist=dist, step=step)[pdf["w"] == 1]
        return pdf[[*ks, "f", "i", "hour", "dist", "step"]]

    return rows.groupBy("f", "border").applyInPandas(finish, schema)


def _stuck(read: DataFrame, ks: list[str], kind: str, k: str, other_of: list[int], rule: Mapping[str | None, tuple[int, int]]) -> DataFrame:
    """Readings of stuck runs: those of runs inside a slice, and of runs that go on over borders and are long enough as a whole."""
    source = [*ks, "f"]
    inside = read.filter(F.col("what") == STUCK).select(*source, "i")
    pieces = read.filter(F.col("what") == PIECE).select(*source, "x", "w", "slice", "edge", "seen")
    # at most two pieces per slice and field: the run at its head (1), at its tail (2), or both in one (3)
    seq = Window.partitionBy("f").orderBy("slice", "edge")
    on = [F.lag(c).over(seq) == F.col(c) for c in [*ks, "x"]]
    on += [F.lag("edge").over(seq).isin(2, 3), F.col("edge").isin(1, 3)]
    joined = on[0]
    for c in on[1:]:
        joined &= c
    chained = pieces.withColumn("new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    chained = chained.withColumn("run", F.sum("new").over(seq.rowsBetween(Window.unboundedPreceding, 0)))
    runs = chained.groupBy(*source, "run").agg(F.sum("w").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("others"), F.collect_list(F.struct("slice", "edge")).alias("at"))
    free = F.element_at(F.array(*[F.lit(o < 0) for o in other_of]), F.col("f") + 1)
    enough = F.lit(False)
    for value, (run, differ) in rule.items():
        mine = F.lit(True) if value is None else F.col(k) == F.lit(value)
        enough |= mine & (F.col("n") >= run) & (free | (F.col("others") >= differ))
    # two rows per slice and field at most; slices of runs that are long enough
    long = runs.filter(enough).select("f", F.explode("at").alias("at")).select("f", "at.slice", "at.edge")
    waiting = read.filter(F.col("what") == EDGE).select(*source, "i", "slice", "edge")
    # the rows of a run that fills its slice were sent as those of its head
    long = long.select("f", "slice", F.when(F.col("edge") == 3, 1).otherwise(F.col("edge")).alias("edge"))
    return inside.unionByName(waiting.join(broadcast_if_small(long, _SMALL), ["f", "slice", "edge"]).select(*source, "i"))


def residuals(v: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance of each reading to the nearer of the levels around it, and its change from the reading before.

    NaN where there is no level on one side, or the reading isn't valid.  What rounding leaves of
    a difference (less than 2**-44 of the reading) is taken off.
    """
    n = len(v)
    with np.errstate(invalid="ignore"):
        valid = np.isfinite(v) & (v > 0)
    x = np.where(valid, v, np.nan)
    levels = []
    for sign in (1, -1):
        near = np.full((n, LEVEL), np.nan)
        for j in range(1, LEVEL + 1):
            if j < n:
                here, there = (slice(j, n), slice(0, n - j)) if sign > 0 else (slice(0, n - j), slice(j, n))
                near[here, j - 1] = np.where(source[here] == source[there], x[there], np.nan)
        near.sort(axis=1)
        m = LEVEL - np.isnan(near).sum(axis=1)
        lo, hi = np.maximum(m - 1, 0) // 2, m // 2
        at = np.arange(n)
        levels.append((near[at, lo] + near[at, np.minimum(hi, LEVEL - 1)]) / 2)
    with np.errstate(invalid="ignore"):
        dist = np.minimum(np.abs(x - levels[0]), np.abs(x - levels[1]))
    step = np.full(n, np.nan)
    if n > 1:
        step[1:] = np.where(source[1:] == source[:-1], np.abs(x[1:] - x[:-1]), np.nan)
    unit = np.exp2(np.floor(np.log2(np.where(valid, v, 1.0))) - 44)
    return np.round(dist / unit) * unit, np.round(step / unit) * unit


class _Run:
    """The open run of equal values of one field."""

    def __init__(self, source: int, value: float, head: bool) -> None:
        self.source, self.value, self.head = source, value, head
        self.n, self.seen, self.decided = 0, set(), False
        self.waiting: list[np.ndarray] = []


class _Field:
    """The readings of one field that are held: those that wait for the next ones, and before them their context."""

    def __init__(self) -> None:
        self.i = self.hour = self.source = np.empty(0, dtype=np.int64)
        self.v = np.empty(0)
        self.sent = self.start = 0
        self.run: _Run | None = None


class _Slice:
    """Reads one sorted slice and emits its readings, the counts of its changes and residuals, stuck readings and what its borders need."""

    def __init__(self, ks: list[str], kind: int, fields: int, other_of: list[int], rule: dict[str | None, tuple[int, int]]) -> None:
        self.ks, self.kind, self.fields, self.other_of, self.rule = ks, kind, fields, other_of, rule
        self.least = min(r for r, _ in rule.values()) if rule else 0

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        self.me = context.partitionId() if context else 0
        self.keys: list[tuple] = []  # of each source of the slice, in order
        self.last: tuple | None = None
        self.held = [_Field() for _ in range(self.fields)]
        self.types: list[pa.DataType] = []
        fresh: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            fresh.append(b)
            n += b.num_rows
            if n >= _BLOCK:
                yield from self._add(fresh, False)
                fresh, n = [], 0
        if fresh or self.types:
            yield from self._add(fresh, True)

    def _add(self, fresh: list[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
        if fresh:
            table = pa.Table.from_batches(fresh).combine_chunks()
            self.types = [table.schema.field(k).type for k in self.ks]
            t, i = table.column("t").to_numpy(), table.column("i").to_numpy()
            codes = [table.column(k).combine_chunks().dictionary_encode() for k in self.ks]
            codes = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in codes]
            at = [c.indices.to_numpy() for c in codes]
            new = np.ones(len(t), dtype=bool)
            new[1:] = np.logical_or.reduce([a[1:] != a[:-1] for a in at])
            names = list(zip(*[c.dictionary.take(pa.array(a[new])).to_pylist() for c, a in zip(codes, at)]))
            if self.keys and names[0] == self.keys[-1]:
                new[0] = False
                names = names[1:]
            source = np.cumsum(new) + len(self.keys) - 1
            self.keys += names
            again = np.zeros(len(t), dtype=bool)
            again[1:] = ~new[1:] & (t[1:] == t[:-1]) & (i[1:] == i[:-1])
            again[0] = self.last == (int(source[0]), int(t[0]), int(i[0]))
            self.last = (int(source[-1]), int(t[-1]), int(i[-1]))
            hour = t // _MICROS_PER_HOUR % 24
            columns = [table.column(f"v{f}") for f in range(self.fields)]
            nulls = [c.is_null().to_numpy() for c in columns]
            raw = [np.where(g, np.nan, c.fill_null(0.0).to_numpy()) for c, g in zip(columns, nulls)]
        for f, held in enumerate(self.held):
            if fresh:
                keep = np.flatnonzero(~nulls[f] & ~again)
                other = raw[self.other_of[f]][keep] if self.other_of[f] >= 0 else None
                yield from self._runs(f, held, source[keep], i[keep], raw[f][keep], other)
                held.source, held.i, held.hour = (np.concatenate([a, b[keep]]) for a, b in ((held.source, source), (held.i, i), (held.hour, hour)))
                held.v = np.concatenate([held.v, raw[f][keep]])
            yield from self._readings(f, held, last)
            if last:
                yield from self._end(f, held)

    def _readings(self, f: int, h: _Field, last: bool) -> Iterator[pa.RecordBatch]:
        """Sends the readings whose neighbours on both sides are there; at the ends of the slice they go to its borders."""
        n = len(h.v)
        upto = n if last else max(h.sent, n - LEVEL)
        if not n or (upto == h.sent and not last):
            return
        dist, step = residuals(h.v, h.source)
        pos = h.start + np.arange(n)
        end = h.start + n if last else np.iinfo(np.int64).max
        mine = np.zeros(n, dtype=bool)
        mine[h.sent : upto] = True
        waits = (pos < LEVEL) | (pos >= end - LEVEL)
        full = mine & ~waits
        yield from self._changes(f, h, full & (step > 0), step)
        go = np.flatnonzero(full & (dist > 0))
        if len(go):
            yield self._out(READING, h.source[go], f=f, i=h.i[go], hour=h.hour[go], x=dist[go])
            bins = np.round(np.log(dist[go]) / _STEP).astype(np.int64)
            low, first = bins.min(), h.source[go[0]]
            span = bins.max() - low + 1
            cell, w = np.unique(((h.source[go] - first) * 24 + h.hour[go]) * span + bins - low, return_counts=True)
            yield self._out(COUNT, first + cell // (24 * span), f=f, hour=cell // span % 24, pos=low + cell % span, w=w)
        if last and end < 2 * LEVEL:
            borders = [(np.arange(n), 0)]
        else:
            borders = [(np.flatnonzero(mine & (pos < 2 * LEVEL)), 1)]
            if last:
                borders.append((np.flatnonzero(pos >= end - 2 * LEVEL), 2))
        for at, edge in borders:
            if len(at):
                mark = np.ones(len(at), dtype=np.int64) if edge == 0 else ((pos[at] < LEVEL) if edge == 1 else (pos[at] >= end - LEVEL)).astype(np.int64)
                yield self._out(SEAM, h.source[at], f=f, i=h.i[at], hour=h.hour[at], x=h.v[at], w=mark, slice=self.me, pos=pos[at], edge=edge)
        if not last:
            drop = max(0, upto - 2 * LEVEL)
            h.source, h.i, h.hour, h.v = h.source[drop:], h.i[drop:], h.hour[drop:], h.v[drop:]
            h.start += drop
            h.sent = upto - drop
        else:
            h.start += n

    def _changes(self, f: int, h: _Field, which: np.ndarray, step: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(which)
        if len(at):
            order = at[np.lexsort((step[at], h.source[at]))]
            s, x = h.source[order], step[order]
            first = np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (x[1:] != x[:-1])))
            yield self._out(CHANGE, s[first], f=f, x=x[first], w=np.diff(np.append(first, len(s))))

    def _runs(self, f: int, h: _Field, source: np.ndarray, i: np.ndarray, v: np.ndarray, other: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        """Follows runs of equal values; decides those that end inside the slice."""
        if not len(v):
            return
        new = np.ones(len(v), dtype=bool)
        new[1:] = (source[1:] != source[:-1]) | ~(v[1:] == v[:-1])
        if h.run is not None:
            new[0] = not (h.run.source == source[0] and h.run.value == v[0])
        heads = np.flatnonzero(np.append(True, new[1:]))
        ends = np.append(heads[1:], len(v))
        long = np.flatnonzero(ends - heads >= max(self.least, 1))
        for k in sorted({0, len(heads) - 1, *long.tolist()}):
            a, b = heads[k], ends[k]
            if k or new[0]:
                yield from self._close(f, h)
                h.run = _Run(int(source[a]), float(v[a]), head=h.run is None)
            yield from self._grow(f, h.run, i[a:b], None if other is None else other[a:b])
            if k < len(heads) - 1:
                yield from self._close(f, h)

    def _grow(self, f: int, run: _Run, i: np.ndarray, other: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        rule = self.rule.get(self.keys[run.source][self.kind]) or self.rule.get(None)
        run.n += len(i)
        if rule and other is not None and len(run.seen) < rule[1]:
            run.seen.update(np.unique(other[~np.isnan(other)])[: rule[1]].tolist())
        run.decided = bool(rule) and run.n >= rule[0] and (other is None or len(run.seen) >= rule[1])
        run.waiting.append(i)
        if run.decided or run.head:
            at = np.concatenate(run.waiting)
            run.waiting = []
            where = np.full(len(at), run.source)
            yield self._out(STUCK, where, f=f, i=at) if run.decided else self._out(EDGE, where, f=f, i=at, slice=self.me, edge=1)

    def _close(self, f: int, h: _Field) -> Iterator[pa.RecordBatch]:
        """The run has ended inside the slice: only one that began before it is still open to the other side."""
        if h.run is not None and h.run.head and h.run.n:
            yield self._piece(f, h.run, 1)
            h.run.head, h.run.n = False, 0
        if h.run is not None:
            h.run.waiting, h.run.value = [], float("nan")

    def _end(self, f: int, h: _Field) -> Iterator[pa.RecordBatch]:
        yield self._out(SIZE, np.zeros(1, dtype=np.int64), f=f, w=np.array([h.start]), slice=self.me)
        run = h.run
        if run is not None and run.n and run.value == run.value:
            if run.waiting and not run.head:
                at = np.concatenate(run.waiting)
                yield self._out(EDGE, np.full(len(at), run.source), f=f, i=at, slice=self.me, edge=2)
            yield self._piece(f, run, 3 if run.head else 2)

    def _piece(self, f: int, run: _Run, edge: int) -> pa.RecordBatch:
        return self._out(PIECE, np.array([run.source]), f=f, x=np.array([run.value]), w=np.array([run.n]), slice=self.me, edge=edge, seen=[sorted(run.seen)])

    def _out(self, what: int, source: np.ndarray, **columns) -> pa.RecordBatch:
        n = len(source)
        need, at = np.unique(source, return_inverse=True)
        keys = list(zip(*[self.keys[s] for s in need.tolist()]))
        arrays = [pa.array(np.full(n, what, dtype=np.int32))]
        arrays += [pa.array(k, t).take(pa.array(at)) for k, t in zip(keys, self.types)]
        for name, kind in (("f", pa.int32()), ("i", pa.int64()), ("hour", pa.int32()), ("x", pa.float64()), ("w", pa.int64()), ("slice", pa.int64()), ("pos", pa.int64()), ("edge", pa.int32()), ("seen", pa.list_(pa.float64()))):
            c = columns.get(name)
            if c is None:
                arrays.append(pa.nulls(n, kind))
            elif isinstance(c, (int, np.integer)):
                arrays.append(pa.array(np.full(n, c), kind))
            else:
                arrays.append(pa.array(c, kind))
        return pa.record_batch(arrays, names=["what", *self.ks, "f", "i", "hour", "x", "w", "slice", "pos", "edge", "seen"])
