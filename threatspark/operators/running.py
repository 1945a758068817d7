"""Ordered computations per key that survive a hot key.

``Window.partitionBy(key)`` sends all rows of a key to one task, so a domain or client with a third of all traffic
would stall the job. Here keys with more than ``ROWS_PER_SLICE`` rows are cut into *slices* along the sort order, at
counted row positions: whatever the times look like (a burst, one wrong clock, no time at all, one and the same time), a
slice holds at most twice that many rows. The row-level window runs per (key, slice); what earlier slices contribute is
carried over from a narrow table with one row per (key, slice), built with map-side aggregation.

Cutting takes one count per key. If no key is heavy, that is all, and the window is an ordinary one; a caller that knows
how many rows there are at most (``at_most``) saves even that. Otherwise the rows of the heavy keys (at most rows /
ROWS_PER_SLICE keys) are counted by stretches of the position. A stretch that is itself too full is sorted over all tasks by
the whole order (time, then the further columns, then a hash of the row) and cut at every ROWS_PER_SLICE-th row, so equal
times can be cut; only rows equal in all columns stay together. The cuts are written to the shared folder: both sides of a
carry-over join read the same ones, whatever is computed again, and the optimizer knows their size.

Key columns travel as one struct, in which NULLs are equal to each other, so rows without a client or name form a group of
their own and none is lost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatspark.session import settled

KEYS, SLICE, POSITION = "_keys", "_slice", "_position"
ROWS_PER_SLICE = 20_000_000
SECOND = 1_000_000
UNTIMED = -(1 << 62)


def epoch_us(ts: Column) -> Column:
    """Event time as microseconds since 1970 (sessions run in UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def time_position(df: DataFrame, order: Sequence[str]) -> Column:
    """Position of a row ordered by ``order``, a time and further columns: its microseconds.

    Rows without a time come first, as they do in the sort order. If the column behind the time is a whole number, they
    are placed by it, so that any number of them can be cut.
    """
    kinds = dict(df.dtypes)
    number = F.lit(0)
    if len(order) > 1 and kinds.get(order[1]) in ("tinyint", "smallint", "int", "bigint"):
        number = F.coalesce(F.col(order[1]).cast("bigint"), F.lit(0))
    return F.coalesce(epoch_us(F.col(order[0])), F.lit(UNTIMED) + number)


def _packed_keys(keys: Sequence[str]) -> Column:
    return F.struct(*keys) if keys else F.struct(F.lit(0).alias("none"))


def heavy_keys(source: DataFrame, keys: Sequence[str], rows: int) -> DataFrame | None:
    """The keys with more than ``rows`` rows, None if there is none."""
    counts = source.groupBy(_packed_keys(keys).alias(KEYS)).agg(F.count(F.lit(1)).alias("_n"))
    heavy = settled(counts.filter(F.col("_n") > rows).select(KEYS), "heavy")
    return None if heavy.isEmpty() else heavy


def finer(df: DataFrame, order: Sequence[str]) -> Column:
    """Where rows of one position stand: the columns of the order, then a hash of the row."""
    return F.struct(*order, F.xxhash64(*df.columns).alias("_hash"))


class RowSlices:
    """The cuts of the heavy keys of a table; none if there is no heavy key.

    ``position`` is a number that does not decrease along the order. Rows of one key at one position stay together, unless
    ``ties`` (see :func:`finer`) orders them. ``at_most`` is a bound of the rows, if one is known.
    """

    def __init__(
        self, source: DataFrame, keys: Sequence[str], position: Column, rows: int | None = None, width: float = SECOND,
        ties: Column | None = None, at_most: int | None = None,
    ) -> None:
        self.rows, self.width, self.ties, self.cuts = rows or ROWS_PER_SLICE, width, ties, None
        if at_most is not None and at_most <= self.rows:
            return
        heavy = heavy_keys(source, keys, self.rows)
        if heavy is None:
            return
        stretches = source.select(_packed_keys(keys).alias(KEYS), self._stretch(position).alias("_stretch"))
        counted = stretches.groupBy(KEYS, "_stretch").agg(F.count(F.lit(1)).alias("_n")).join(heavy, KEYS, "left_semi")
        before = F.coalesce(F.sum("_n").over(Window.partitionBy(KEYS).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counted = settled(counted.withColumn("_before", before), "stretches")
        base = F.floor(F.col("_before") / self.rows).alias("_base")
        full = counted.filter(F.col("_n") > self.rows)
        if full.isEmpty():
            self.ties = None  # nothing is cut within a stretch
            place = source.select(self._place(position).alias(POSITION)).schema[POSITION].dataType
            self.cuts = counted.select(KEYS, "_stretch", base, F.array().cast(T.ArrayType(place)).alias("_bounds"))
            return
        placed = source.select(_packed_keys(keys).alias(KEYS), self._stretch(position).alias("_stretch"), self._place(position).alias(POSITION))
        bounds = self._bounds(placed.join(full.select(KEYS, "_stretch", "_before"), [KEYS, "_stretch"]))
        self.cuts = settled(counted.select(KEYS, "_stretch", base).join(bounds, [KEYS, "_stretch"], "left"), "cuts")

    def _bounds(self, placed: DataFrame) -> DataFrame:
        """The places where slices begin within too full stretches, by a sort over all tasks and one count for each task."""
        group = [KEYS, "_stretch"]
        line = placed.orderBy(*group, POSITION).withColumn("_id", F.monotonically_increasing_id())
        line = settled(line.withColumn("_part", F.shiftrightunsigned("_id", 33)), "places")
        parts = line.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
        ahead = F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
        parts = settled(parts.select(*group, "_part", "_first", F.coalesce(ahead, F.lit(0)).alias("_ahead")), "parts")
        rank = F.col("_before") + F.col("_ahead") + F.col("_id") - F.col("_first")
        starts = line.join(parts, [*group, "_part"]).filter((rank % self.rows == 0) & (rank > F.floor(F.col("_before") / self.rows) * self.rows))
        # as many bounds as the stretch holds slices
        return starts.groupBy(*group).agg(F.collect_list(POSITION).alias("_bounds"))

    def _place(self, position: Column) -> Column:
        return F.struct(position.alias("at"), *([] if self.ties is None else [self.ties.alias("tie")]))

    def _stretch(self, position: Column) -> Column:
        return F.floor(position / self.width)

    def pack(self, df: DataFrame, keys: Sequence[str], position: Column, **columns: Column) -> DataFrame:
        """The rows with their keys as one struct, the number of the slice and further columns."""
        packed = _pack(df, keys, position, **columns)
        if self.cuts is None:
            return packed.withColumn(SLICE, F.struct(F.lit(0).alias("at")))
        rest = [c for c in packed.columns if c != SLICE]
        packed = _pack(df, keys, position, **columns, **{POSITION: self._place(position)}).drop(SLICE)
        cuts = self.cuts.withColumnsRenamed({KEYS: "_cut_keys", "_stretch": "_cut_stretch"})
        found = packed.join(cuts, (F.col(KEYS) == F.col("_cut_keys")) & (self._stretch(F.col(f"{POSITION}.at")) == F.col("_cut_stretch")), "left")
        passed = F.coalesce(F.size(F.filter("_bounds", lambda b: b <= F.col(POSITION))), F.lit(0))
        number = F.coalesce(F.col("_base") + F.greatest(passed, F.lit(0)), F.lit(0))
        return found.withColumn(SLICE, F.struct(number.alias("at"))).select(*rest, SLICE)


def hash_slice(digest: Column, digits: int = 4) -> Column:
    """Leading hex digits of a digest: slices in digest order, 65536 of them by default."""
    return F.substring(digest, 1, digits)


def _pack(df: DataFrame, keys: Sequence[str], slice_by: Column, **columns: Column) -> DataFrame:
    """The rows with their keys as one struct, the slice as another (NULL slices are equal, too) and further columns."""
    rest = [c for c in df.columns if c not in keys]
    return df.select(*rest, _packed_keys(keys).alias(KEYS), F.struct(slice_by.alias("at")).alias(SLICE), *[c.alias(n) for n, c in columns.items()])


def _unpack(df: DataFrame, columns: Sequence[str], keys: Sequence[str], *more: str) -> DataFrame:
    """The original columns in their order, and more."""
    return df.select(*[F.col(f"{KEYS}.{c}").alias(c) if c in keys else c for c in columns], *more)


def _rows(order: Sequence[Column | str]) -> WindowSpec:
    return Window.partitionBy(KEYS, SLICE).orderBy(*order)


def _slices(descending: bool = False) -> WindowSpec:
    return Window.partitionBy(KEYS).orderBy(F.col(SLICE).desc() if descending else F.col(SLICE).asc())


def _earlier(descending: bool = False) -> WindowSpec:
    return _slices(descending).rowsBetween(Window.unboundedPreceding, -1)


def _so_far(spec: WindowSpec) -> WindowSpec:
    return spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def ranked(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], slice_by: Column, name: str, total: str | None = None
) -> DataFrame:
    """``row_number() over (partition by keys order by order)`` for slices given by an expression that must not decrease
    along the order. With ``total`` the number of rows of the key is added as well."""
    return _ranked(df, _pack(df, keys, slice_by), keys, order, name, total)


def _ranked(df: DataFrame, packed: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str, total: str | None) -> DataFrame:
    counts = packed.select(KEYS, SLICE).groupBy(KEYS, SLICE).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(_earlier()), F.lit(0)).alias("_n0")
    whole = [F.sum("_n").over(Window.partitionBy(KEYS)).alias(total)] if total else []
    numbered = packed.withColumn("_rn", F.row_number().over(_rows(order)))
    joined = numbered.join(counts.select(KEYS, SLICE, before, *whole), [KEYS, SLICE]).withColumn(name, F.col("_rn") + F.col("_n0"))
    return _unpack(joined, df.columns, keys, name, *([total] if total else []))


def row_number(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, rows: int | None = None, at_most: int | None = None
) -> DataFrame:
    """``row_number() over (partition by keys order by order)``; ``order`` starts with a time."""
    position = time_position(df, order)
    slices = RowSlices(df, keys, position, rows, ties=finer(df, order), at_most=at_most)
    if slices.cuts is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    return _ranked(df, slices.pack(df, keys, position), keys, order, name, None)


def running_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], position: Column, sums: dict[str, Column],
    descending: bool = False, rows: int | None = None, width: float = SECOND,
) -> DataFrame:
    """Cumulative sums per key up to and including each row. ``descending`` when the position falls along the order."""
    slices = RowSlices(df, keys, position, rows, width)
    if slices.cuts is None:
        spec = _so_far(Window.partitionBy(*keys).orderBy(*order))
        return df.withColumns({n: F.sum(c).over(spec) for n, c in sums.items()})
    # written once: the sums and what they carry over read the same cut rows
    cut = settled(slices.pack(df, keys, position, **{f"_v_{n}": c for n, c in sums.items()}), "cut-rows")
    totals = cut.groupBy(KEYS, SLICE).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    earlier = _earlier(descending)
    carried = totals.select(
        KEYS, SLICE, *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in sums]
    )
    summed = cut.withColumns({f"_r_{n}": F.sum(f"_v_{n}").over(_so_far(_rows(order))) for n in sums})
    joined = summed.join(carried, [KEYS, SLICE]).withColumns({n: F.col(f"_r_{n}") + F.col(f"_c_{n}") for n in sums})
    return _unpack(joined, df.columns, keys, *sums)


def running_count_variance(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, count_name: str, variance_name: str,
    rows: int | None = None,
) -> DataFrame:
    """Row count and sample variance of ``value`` per key up to and including each row (0 for a single row).

    Within a slice the window keeps count, mean and squared deviations from the mean. Earlier slices are merged around the
    mean of the key's first slice, so large values with a small spread lose no digits.
    """
    v, position = F.col(value).cast("double"), time_position(df, order)
    slices = RowSlices(df, keys, position, rows, ties=finer(df, order))
    if slices.cuts is None:
        spec = _so_far(Window.partitionBy(*keys).orderBy(*order))
        return df.withColumns({
            count_name: F.count(F.lit(1)).over(spec), variance_name: F.coalesce(F.var_samp(v).over(spec), F.lit(0.0)),
        })
    cut = slices.pack(df, keys, position, _v=v)
    moments = cut.groupBy(KEYS, SLICE).agg(
        F.count(F.lit(1)).alias("_rows"), F.count("_v").alias("_n"), F.avg("_v").alias("_m"), F.var_pop("_v").alias("_d"))
    whole = _slices().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    centred = moments.withColumn("_k", F.first("_m", ignorenulls=True).over(whole)).withColumn("_off", F.col("_m") - F.col("_k"))
    sums = {
        "_n0": F.col("_n"), "_rows0": F.col("_rows"), "_s0": F.col("_n") * F.col("_off"),
        "_q0": F.col("_n") * (F.col("_d") + F.col("_off") * F.col("_off")),
    }
    carried = centred.select(KEYS, SLICE, "_k", *[F.coalesce(F.sum(c).over(_earlier()), F.lit(0)).alias(n) for n, c in sums.items()])
    spec = _so_far(_rows(order))
    here = cut.withColumns({
        "_rows1": F.count(F.lit(1)).over(spec), "_n1": F.count("_v").over(spec), "_m1": F.avg("_v").over(spec), "_d1": F.var_pop("_v").over(spec),
    })
    joined = here.join(carried, [KEYS, SLICE])
    off = F.coalesce(F.col("_m1") - F.col("_k"), F.lit(0.0))
    n = F.col("_n0") + F.col("_n1")
    s = F.col("_s0") + F.col("_n1") * off
    q = F.col("_q0") + F.col("_n1") * (F.coalesce("_d1", F.lit(0.0)) + off * off)
    spread = F.greatest(q - s * s / n, F.lit(0.0))
    out = joined.withColumns({
        count_name: F.col("_rows0") + F.col("_rows1"), variance_name: F.when(n > 1, spread / (n - 1)).otherwise(F.lit(0.0)),
    })
    return _unpack(out, df.columns, keys, count_name, variance_name)


def seconds_since_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, rows: int | None = None) -> DataFrame:
    """Seconds from the previous row of the same key; NULL for the first. ``order`` starts with a time."""
    position, us = time_position(df, order), epoch_us(F.col(order[0]))
    slices = RowSlices(df, keys, position, rows, ties=finer(df, order))
    if slices.cuts is None:
        return df.withColumn(name, (us - F.lag(us).over(Window.partitionBy(*keys).orderBy(*order))) / F.lit(1e6))
    cut = slices.pack(df, keys, position, _us=us)
    ends = cut.groupBy(KEYS, SLICE).agg(F.max("_us").alias("_end"))
    carried = ends.select(KEYS, SLICE, F.lag("_end").over(_slices()).alias("_before"))
    lagged = cut.withColumns({"_prev": F.lag("_us").over(_rows(order)), "_first": F.row_number().over(_rows(order)) == 1})
    seconds = (F.col("_us") - F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_prev"))) / F.lit(1e6)
    return _unpack(lagged.join(carried, [KEYS, SLICE]).withColumn(name, seconds), df.columns, keys, name)


def count_in_last_seconds(
    df: DataFrame, keys: Sequence[str], ts: str, seconds: int, name: str, rows: int | None = None, at_most: int | None = None
) -> DataFrame:
    """Rows of the same key in the ``seconds`` up to and including each row, peers in time included.

    Rows of one key without a time are peers of each other. With a heavy key the times of a key become one line of events:
    the rows of a time enter at it and leave just after the window of ``seconds``. One running sum along the line is the
    count, so a window needs no look back, whatever it holds.
    """
    span, us = seconds * SECOND, epoch_us(F.col(ts))
    position, few = time_position(df, [ts]), rows or ROWS_PER_SLICE
    if at_most is not None and at_most <= few or heavy_keys(df, keys, few) is None:
        return df.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(*keys).orderBy(us).rangeBetween(-span, 0)))
    # one row for each key and time: no event of the line has a peer of its kind
    times = settled(df.select(*keys, position.alias("_at")).groupBy(*keys, "_at").agg(F.count(F.lit(1)).alias("_here")), "times")
    leaves = F.col("_at") >= UNTIMED // 2
    events = F.array(
        F.struct(F.col("_at").alias("_on"), F.lit(1).alias("_enters"), F.col("_here").alias("_change")),
        F.struct((F.col("_at") + F.when(leaves, F.lit(span + 1)).otherwise(0)).alias("_on"), F.lit(0).alias("_enters"), (-F.col("_here")).alias("_change")),
    )
    # rows without a time stand before all windows: they leave before they enter, and are counted among themselves
    line = times.select(*keys, "_at", F.explode(events).alias("_e")).select(*keys, "_at", "_e.*")
    counted = running_sums(line, keys, ["_on", "_enters"], F.col("_on"), {"_inside": F.col("_change")}, rows=rows).filter("_enters = 1")
    value = F.when(F.col("_at") < UNTIMED // 2, F.col("_change")).otherwise(F.col("_inside"))
    found = counted.select(_packed_keys(keys).alias("_found_keys"), F.col("_at").alias("_found_at"), value.alias(name))
    packed = df.withColumns({"_k": _packed_keys(keys), "_at": position})
    joined = packed.join(found, (F.col("_k") == F.col("_found_keys")) & (F.col("_at") == F.col("_found_at")))
    return joined.select(*df.columns, name)


def last_before(
    left: DataFrame, left_at: str, right: DataFrame, right_at: str, value: str, keys: Sequence[str], name: str,
    strict: bool = False, rows: int | None = None, at_most: int | None = None,
) -> DataFrame:
    """As-of lookup: for each left row the last ``value`` of the right rows with equal keys at or before it (before it, if
    ``strict``); NULL without one, and for left rows without a position. Values must not decrease along the right rows."""
    sides = [
        (left.withColumns({"_asked": F.col(left_at), "_found": F.lit(None).cast(right.schema[value].dataType), "_side": F.lit(0 if strict else 1)})),
        right.select(*keys, F.col(right_at).alias("_asked"), F.col(value).alias("_found"), F.lit(1 if strict else 0).alias("_side"))
        .filter(F.col("_asked").isNotNull() & F.col("_found").isNotNull()),
    ]
    rows_of = sides[0].unionByName(sides[1], allowMissingColumns=True).withColumn("_left", F.col("_side") == (0 if strict else 1))
    position = F.coalesce(F.col("_asked"), F.lit(2 * UNTIMED + 1))
    order = ["_asked", "_side"]
    slices = RowSlices(rows_of, keys, position, rows, ties=finer(rows_of, order), at_most=at_most)
    if slices.cuts is None:
        spec = _so_far(Window.partitionBy(*keys).orderBy(*order))
        return rows_of.withColumn(name, F.last("_found", ignorenulls=True).over(spec)).filter("_left").select(*left.columns, name)
    cut = slices.pack(rows_of, keys, position)
    ends = cut.groupBy(KEYS, SLICE).agg(F.max("_found").alias("_end"))
    carried = ends.select(KEYS, SLICE, F.max("_end").over(_earlier()).alias("_before"))
    inside = cut.withColumn("_in", F.last("_found", ignorenulls=True).over(_so_far(_rows(order)))).filter("_left")
    value_at = F.when(F.col("_asked").isNotNull(), F.coalesce("_in", "_before"))
    return _unpack(inside.join(carried, [KEYS, SLICE]).withColumn(name, value_at), left.columns, keys, name)


def latest_before(
    left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, name: str, rows: int | None = None, at_most: int | None = None
) -> DataFrame:
    """As-of join: for each left row the latest right time at or before it with equal keys, NULL without one.

    As in any join, a NULL key has no partner.
    """
    seen = right.select(*keys, epoch_us(F.col(ts)).alias("_us")).dropna()
    asked = left.withColumn("_us", epoch_us(F.col(ts)))
    found = last_before(asked, "_us", seen, "_us", "_us", keys, "_latest", rows=rows, at_most=at_most)
    return found.select(*left.columns, F.timestamp_micros("_latest").alias(name))
