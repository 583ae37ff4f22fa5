"""Predictions from history: box neighbours, regressions, cascades, ranked plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..sources.storage import stored


#: The bin that every history row of a signed ratio is in, besides its own.
EVERY = -(2**40)


def box_join(
    probes: DataFrame, history: DataFrame, on: list[str], steps: dict[str, float], ratios: dict[str, float], signed: bool = False, shares: int = 1,
) -> DataFrame:
    """Pairs of probe (``p_``) and history (``h_``) rows that agree in ``on``, differ by at most ``steps`` absolutely and by
    at most ``ratios`` of the probe's value.  Every tolerance becomes a bin on both sides, the probe's exploded over
    the bins it can reach, so that the join is an equi-join; the tolerances are then verified.  Both sides are shuffled:
    Spark's estimate of a side leaves out what bins multiply it by, and would send it whole through the driver.

    ``signed``: the values of ``ratios`` may be of any sign and size.  A difference over a value below 0 is within any ratio, so such a
    probe reaches every bin; one over 0 is within none.  ``shares``: the probes of a bin are dealt into so many, each
    with all history rows of the bin, for joins whose bins are few."""
    p = probes.select(*(F.col(c).alias(f"p_{c}") for c in probes.columns))
    h = history.select(*(F.col(c).alias(f"h_{c}") for c in history.columns))
    keys = [F.col(f"p_{c}") == F.col(f"h_{c}") for c in on]
    test = F.lit(True)
    if shares > 1:
        p = p.withColumn("pb_", F.pmod(F.xxhash64(*p.columns), F.lit(shares)).cast("int"))
        h = h.withColumn("hb_", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
        keys.append(F.col("pb_") == F.col("hb_"))
    for c, step in steps.items():
        a, b = F.col(f"p_{c}"), F.col(f"h_{c}")
        h = h.withColumn(f"hb_{c}", F.floor(b / step))
        p = p.withColumn(f"pb_{c}", F.explode(F.sequence(F.floor((a - step) / step), F.floor((a + step) / step))))
        keys.append(F.col(f"pb_{c}") == F.col(f"hb_{c}"))
        test = test & (F.abs(b - a) <= step)
    for c, r in ratios.items():
        a, b = F.col(f"p_{c}"), F.col(f"h_{c}")
        bin_of = lambda x, r=r: F.floor(F.log(F.greatest(F.least(x.cast("double"), F.lit(1e300)), F.lit(1e-9))) / F.log(F.lit(1 + r)))
        own, reach = bin_of(b), F.sequence(bin_of(a * (1 - r)) - 1, bin_of(a * (1 + r)) + 1)
        h = h.withColumn(f"hb_{c}", F.explode(F.array(own, F.lit(EVERY))) if signed else own)
        p = p.withColumn(f"pb_{c}", F.explode(F.when(a < 0, F.array(F.lit(EVERY))).when(a > 0, reach) if signed else reach))
        keys.append(F.col(f"pb_{c}") == F.col(f"hb_{c}"))
        test = test & ((F.try_divide(F.abs(b - a), a) if signed else F.abs(b - a) / a) <= r)
    on_all = keys[0]
    for k in keys[1:]:
        on_all = on_all & k
    joined = p.join(h.hint("merge"), on_all).filter(test)
    return joined.drop("pb_", "hb_", *(f"{x}b_{c}" for c in (*steps, *ratios) for x in "ph"))


def weighted_sums(pairs: DataFrame, keys: list[str], value: Column, distance: Column, copies: Column | None = None, positive: bool = True) -> DataFrame:
    """Sums of the weights 1 / (0.05 + distance) (``sw``), of weighted values (``sv``) and of their weighted squares
    (``sq``), and the count ``n``.  A row stands for ``copies`` equal ones.  ``positive``: only values above 0 count."""
    copies = F.lit(1).cast("bigint") if copies is None else copies
    w = F.coalesce(F.try_divide(F.lit(1.0), F.lit(0.05) + distance), F.lit(float("inf"))) * copies
    rows = pairs.filter(value > 0 if positive else value.isNotNull()).select(*keys, value.alias("v"), w.alias("w"), copies.alias("k"))
    return rows.groupBy(*keys).agg(F.sum("w").alias("sw"), F.sum(F.col("v") * F.col("w")).alias("sv"), F.sum(F.col("v") * F.col("v") * F.col("w")).alias("sq"), F.sum("k").alias("n"))


#: What :func:`weighted_sums` finds; those of several rows add up.
SUMS = ["sw", "sv", "sq", "n"]


def profiled(sums: DataFrame) -> DataFrame:
    """``SUMS`` turned into the weighted mean, the population deviation (``std``) and the count."""
    mean = F.try_divide("sv", "sw")
    std = F.sqrt(F.greatest(F.lit(0.0), F.try_divide("sq", "sw") - mean * mean))
    return sums.select(*(c for c in sums.columns if c not in SUMS), mean.alias("mean"), F.when(mean.isNotNull(), std).alias("std"), "n")


def with_sums(
    rows: DataFrame, on: list[str], steps: dict[str, float], ratios: dict[str, float], value: str, distance: Column, how: str, positive: bool, shares: int,
) -> DataFrame:
    """``rows`` with the ``SUMS`` of each row's neighbours by :func:`box_join` among the rows, itself included.  Rows that
    agree in all these columns have one result and count as one neighbour with copies, so that pairs grow with the
    distinct rows.  ``how``: ``left`` keeps rows without neighbours."""
    spot = [*on, *dict.fromkeys([*steps, *ratios, value])]
    spots = stored(rows.groupBy(*spot).agg(F.count("*").alias("copies")), "spots")
    pairs = box_join(spots.drop("copies"), spots, on, steps, ratios, signed=True, shares=shares)
    found = weighted_sums(pairs, [f"p_{c}" for c in spot], F.col(f"h_{value}"), distance, F.col("h_copies"), positive)
    found = found.withColumnsRenamed({f"p_{c}": c for c in spot})
    return rows.join(found.hint("merge"), spot, how)


def box_profiles(
    rows: DataFrame, item: str, on: list[str], steps: dict[str, float], ratios: dict[str, float], value: str, distance: Column, positive: bool = True, shares: int = 1,
) -> DataFrame:
    """(item, mean, std, n): distance-weighted mean and deviation of ``value`` and the count, over the neighbours of all rows
    of an item, a neighbour of two of them twice.  ``positive``: neighbours whose value is 0 or less don't count."""
    found = with_sums(rows, on, steps, ratios, value, distance, "inner", positive, shares)
    return profiled(found.groupBy(item).agg(*(F.sum(c).alias(c) for c in SUMS)))


def with_profiles(
    rows: DataFrame, item: str, on: list[str], steps: dict[str, float], ratios: dict[str, float], value: str, distance: Column, positive: bool = True, shares: int = 1,
) -> DataFrame:
    """All ``rows`` with mean, std and n of the :func:`box_profiles` of their item; null where that has no neighbours, and for
    rows without an item, which are dealt out by their other columns."""
    found, known = with_sums(rows, on, steps, ratios, value, distance, "left", positive, shares), F.col(item).isNotNull()
    same = Window.partitionBy(item, F.when(~known, F.xxhash64(*rows.columns)))
    return profiled(found.withColumns({c: F.when(known, F.sum(c).over(same)) for c in SUMS}))


def ols(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least-squares slope and intercept; missing sizes count as 0; null for one point or equal x."""
    a, b = F.coalesce(F.col(x), F.lit(0.0)), F.coalesce(F.col(y), F.lit(0.0))
    return rows.groupBy(*keys).agg(F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.count("*").alias("n"))


def scale_cascade(probes: DataFrame) -> DataFrame:
    """Initial scale and its source from columns avg_scale, nb_mean, nb_std, nb_n, delta, size, bias, frames."""
    c = F.col
    safety = F.when((c("nb_n") >= 4) & (c("nb_std") <= 0.035), 0.985).otherwise(0.95)
    near = F.greatest(c("nb_mean") * safety, F.sqrt(rules.MID / c("size")) * 0.99)
    by_delta = rules.long_bias(F.sqrt(rules.MID / (c("size") + c("delta") * c("bias"))) * 0.97, c("frames"), c("size"))
    by_formula = rules.long_bias(F.sqrt(rules.MID / (c("size") * c("bias"))) * 0.95, c("frames"), c("size"))
    known, neighbour, delta = F.coalesce(c("avg_scale"), F.lit(0.0)) != 0, c("nb_n") > 0, c("delta").isNotNull()
    scale = F.when(known, c("avg_scale")).when(neighbour, near).when(delta, by_delta).otherwise(by_formula)
    source = F.when(known, "stats").when(neighbour, "neighbor stats").when(delta, "delta_avg").otherwise("formula")
    return probes.withColumn("scale", scale).withColumn("source", source)


def size_cascade(probes: DataFrame) -> DataFrame:
    """Predicted size from columns slope, intercept, delta, size, bias, source: regression, else mean difference, else
    the bias; clamped, raised by the source's extra bias and clamped again."""
    c = F.col
    raw = F.coalesce(c("slope") * c("size") + c("intercept"), c("size") + c("delta") * c("bias"), c("size") * c("bias"))
    once = rules.clamp_prediction(raw, c("size"))
    extra = F.when(c("source") == "stats", once * 1.08).when(c("source").startswith("neighbor stats"), once * 1.04).otherwise(once)
    return probes.withColumn("predicted", rules.clamp_prediction(extra, c("size")))


def best_by(rows: DataFrame, keys: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """The first row of each key in ``order``, by a map-side combined minimum."""
    rank = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*keep), rank).alias("r")).select(*keys, "r.*")


def loglog_last3(rows: DataFrame, key: str, order: list[str], quality: str, size: str) -> DataFrame:
    """alpha and C of size = C * q ** alpha over the last three observations of a key; null for fewer than two points,
    for two points under 2 apart, or alpha outside 0.2..5."""
    top = Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order))
    last = rows.withColumn("rn", F.row_number().over(top)).filter("rn <= 3").filter((F.col(quality) > 0) & (F.col(size) > 0))
    fit = last.groupBy(key).agg(F.count("*").alias("n"), F.regr_slope(F.log(size), F.log(quality)).alias("a"), F.regr_intercept(F.log(size), F.log(quality)).alias("b"), (F.max(quality) - F.min(quality)).alias("spread"))
    ok = (F.col("n") >= 2) & F.col("a").between(0.2, 5.0) & ((F.col("n") > 2) | (F.col("spread") >= 2))
    return fit.select(key, "n", F.when(ok, F.col("a")).alias("alpha"), F.when(ok, F.exp("b")).alias("c"))


def piecewise_quality(points: DataFrame, key: str, quality: str, size: str, target: float, low: int, high: int) -> DataFrame:
    """Quality that meets ``target`` by log-linear interpolation between the first neighbours around it; 6 beyond the end
    points outside; null for fewer than two points.  Points are one per quality."""
    w = Window.partitionBy(key).orderBy(quality)
    pairs = points.select(key, F.col(quality).alias("q0"), F.col(size).alias("s0"), F.lead(quality).over(w).alias("q1"), F.lead(size).over(w).alias("s1"))
    hit = F.col("q1").isNotNull() & (F.lit(target).between(F.col("s0"), F.col("s1")) | F.lit(target).between(F.col("s1"), F.col("s0")))
    l0, l1 = (F.log(F.greatest(F.lit(0.01), F.col(c).cast("double"))) for c in ("s0", "s1"))
    mid = F.when(F.abs(l1 - l0) < 1e-9, F.bround((F.col("q0") + F.col("q1")) / 2)).otherwise(F.bround(F.col("q0") + (F.log(F.lit(max(0.01, target))) - l0) / F.when(l1 != l0, l1 - l0) * (F.col("q1") - F.col("q0"))))
    agg = pairs.groupBy(key).agg(F.count("*").alias("n"), F.min_by(mid, F.when(hit, F.col("q0"))).alias("inside"), F.min_by(F.struct("q0", "s0"), "q0").alias("first"), F.max_by(F.struct("q0", "s0"), "q0").alias("last"))
    q = F.coalesce("inside", F.when(F.col("last.s0") < target, F.col("last.q0") + 6).when(F.col("first.s0") > target, F.col("first.q0") - 6))
    return agg.select(key, F.when(F.col("n") >= 2, rules.clamp(q, low, high)).cast("int").alias("quality"))


#: Relative difference of width, height and frames, tolerance of the initial size in MB (the larger of two),
#: fewest observations without a strong match, and the margin around the target band.
MATCH_RATIO, INIT_TOLERANCE, MIN_COUNT, BAND_MARGIN = 0.03, 0.35, 2, 0.3


def startup_plan(probes: DataFrame, history: DataFrame, low: float = rules.TARGET_MIN, high: float = rules.TARGET_MAX) -> DataFrame:
    """One row for each probe (id, width, height, frames, init_mb): quality, method, direct_final, result_mb, pre_width,
    pre_height, source.

    History rows (width, height, frames, init_mb, quality, method, result_mb, count, timestamp, resize_count, final_width,
    final_height) fit a probe if width, height and frames differ by 3 per cent at most and the initial size by the tolerance,
    the result lay near the band, and the row stands for two observations at least or is a strong match: the same width,
    height and frames.  The best is a strong match, then an exact one, then nearest in initial size, then in result to the
    band's middle, then the latest.  A probe without one gets a quality seeded by the ratio of sizes.

    The join is on bins of initial size and width; the other tolerances are tested on what shares them.  Probes of one
    shape (width, height, frames, init_mb) have one plan, which is looked for once."""
    c, tolerance, shape = F.col, max(0.15, INIT_TOLERANCE), ["width", "height", "frames", "init_mb"]
    history = stored(history, "history")
    fits = history.filter(c("result_mb").between(low - BAND_MARGIN, high + BAND_MARGIN))
    count = F.when(F.coalesce("h_count", F.lit(0)) == 0, 1).otherwise(c("h_count"))

    def fitting(p: DataFrame) -> DataFrame:
        off = {f: F.abs(c(f"h_{f}") - c(f"p_{f}")) / F.greatest(c(f"p_{f}"), F.lit(1)) for f in ("width", "height", "frames")}
        init = F.abs(c("h_init_mb") - c("p_init_mb"))
        equal = (c("h_width") == c("p_width")) & (c("h_height") == c("p_height")) & (c("h_frames") == c("p_frames"))
        pairs = box_join(p, fits, [], {"init_mb": tolerance}, {"width": MATCH_RATIO})
        pairs = pairs.filter((off["height"] <= MATCH_RATIO) & (off["frames"] <= MATCH_RATIO)).withColumn("strong", equal).filter((count >= MIN_COUNT) | c("strong"))
        exact = (off["width"] < 1e-6) & (off["height"] < 1e-6) & (off["frames"] < 1e-6) & (init < 1e-6)
        pairs = pairs.withColumn("exact", exact).withColumn("init_diff", init).withColumn("n_count", count)
        return pairs.withColumn("kind", 2 * (~c("strong")).cast("int") + (~c("exact")).cast("int"))

    # The least difference of each kind is found first, from numbers alone, so that only what has it is ranked.
    shapes = stored(probes.select(shape).distinct(), "shapes")
    least = fitting(shapes).groupBy(*(f"p_{x}" for x in shape)).agg(*(F.min(F.when(c("kind") == k, c("init_diff"))).alias(f"d{k}") for k in range(4)))
    kind = F.coalesce(*(F.when(c(f"d{k}").isNotNull(), F.lit(k)) for k in range(4)))
    least = stored(least.select(*(c(f"p_{x}").alias(x) for x in shape), kind.alias("best"), F.coalesce(*(f"d{k}" for k in range(4))).alias("least")), "least")
    pairs = fitting(least).filter((c("kind") == c("p_best")) & (c("init_diff") == c("p_least")))
    resized = F.coalesce("h_resize_count", F.lit(0))
    room = (c("h_final_width") > 0) & (c("h_final_height") > 0) & (c("h_final_width") <= c("p_width")) & (c("h_final_height") <= c("p_height"))
    pre = F.coalesce((resized > 0) & room, F.lit(False))
    order = [~c("strong"), ~c("exact"), c("init_diff"), F.abs(c("h_result_mb") - (low + high) / 2), -c("h_timestamp"), c("h_quality"), c("h_method")]
    kept = [
        c("h_quality").alias("quality"), c("h_method").alias("method"), (c("strong") & ((resized == 0) | pre)).alias("direct_final"), c("h_result_mb").alias("result_mb"), F.when(pre, c("h_final_width")).alias("pre_width"),
        F.when(pre, c("h_final_height")).alias("pre_height"), c("strong"), c("exact"), c("n_count"),
    ]
    best = best_by(pairs, [f"p_{x}" for x in shape], order, kept).withColumnsRenamed({f"p_{x}": x for x in shape})
    records = history.agg(F.count("*").alias("records"))
    rows = probes.select("id", *shape).join(best.hint("merge"), shape, "left").crossJoin(F.broadcast(records))
    seeded = rules.seeded_quality(c("init_mb"), (low + high) / 2, 60, 95)
    said = F.format_string(
        "%s (%s, records=%d, count=%d)", F.when(c("exact"), "webp exact stats").otherwise("webp stats"), F.when(c("strong"), "direct-final").otherwise("probe-guided"), "records", "n_count",
    )
    none = F.format_string("default (no webp match, records=%d, ratio-seeded q=%d)", "records", seeded)
    known = c("strong").isNotNull()
    return rows.select(
        "id", F.when(known, c("quality")).otherwise(seeded).alias("quality"), "method", F.coalesce("direct_final", F.lit(False)).alias("direct_final"), "result_mb", "pre_width", "pre_height",
        F.when(known, said).otherwise(none).alias("source"),
    )


def relative_score(features: list[str]) -> Column:
    """The sum of the differences of ``p_`` and ``h_`` features, each over the probe's own (1 at least)."""
    parts = [F.abs(F.col(f"h_{f}").cast("double") - F.col(f"p_{f}").cast("double")) / F.greatest(F.col(f"p_{f}").cast("double"), F.lit(1.0)) for f in features]
    score = parts[0]
    for x in parts[1:]:
        score = score + x
    return score


#: Cells have ends apart by a factor of (1 + 1 / 64) ** 2 ** shift; those of one shift lie within those of the next.  Rows that a
#: cell of the first table, and of the narrowest, has in the mean, at least.
SHIFTS, CELL_ROWS, LAST_ROWS = (1, 3, 5, 7, 9), 256, 8


def cell_of(x: Column, shift: int) -> Column:
    """The number of a value's cell; all values up to 1 are in the first."""
    return F.shiftright(F.floor(F.log(F.greatest(x.cast("double"), F.lit(1.0))) / F.log(F.lit(1 + 2.0**-6))), shift)


def nearest_by_score(probes: DataFrame, history: DataFrame, on: str, features: list[str], order: str, keep: list[str]) -> DataFrame:
    """(id, keep..., score): for each probe (id, on, features) the history row of its ``on`` with the least
    :func:`relative_score`, the first in ``order`` of equal ones; probes whose ``on`` has no complete row are left out.

    History rows are counted into cells, each with the ends of what it holds and one of its rows.  Probes, those of equal
    features as one, descend from wide cells to narrow ones: what is in a probe's nearest cell gives a bound, and cells whose
    nearest corner is farther off are left out.  The first table of cells has many rows in each, so it is small; only rows of the cells that are left
    there are shuffled, and narrower cells are made from these."""
    c, spot, each = F.col, [on, *features], range(len(features))
    cells = [f"c{i}" for i in each]
    own = [c(f"p_{f}").cast("double") for f in features]
    h = history.dropna(subset=spot).select(on, *(c(f).alias(f"h_{f}") for f in features), F.struct(order, *(k for k in keep if k != order)).alias("kept"))
    p = probes.dropna(subset=spot).select(spot).distinct().withColumn("probe", F.monotonically_increasing_id())
    p = stored(p.select("probe", on, *(c(f).alias(f"p_{f}") for f in features)), "probes")
    at = lambda shift: [cell_of(c(f"h_{f}"), shift) for f in features]

    # Sums may differ in their last digits, so the bound is a little larger.
    within = lambda x: x <= c("bound") * (1 + 1e-9) + 1e-9

    def counted(rows: DataFrame, shift: int) -> DataFrame:
        # All first values are those of one row, as they are set together; as numbers, not as a struct, they need no sort.
        ends = [x for i, f in enumerate(features) for x in (F.min(f"h_{f}").alias(f"low{i}"), F.max(f"h_{f}").alias(f"high{i}"), F.first(f"h_{f}").alias(f"one{i}"))]
        return stored(rows.groupBy(on, *(x.alias(n) for x, n in zip(at(shift), cells))).agg(*ends), "cells")

    def wider(table: DataFrame, by: int) -> DataFrame:
        ends = [x for i in each for x in (F.min(f"low{i}").alias(f"low{i}"), F.max(f"high{i}").alias(f"high{i}"), F.first(f"one{i}").alias(f"one{i}"))]
        return table.groupBy(on, *(F.shiftright(n, by).alias(n) for n in cells)).agg(*ends)

    def tight(near: DataFrame, met: Callable[[DataFrame], DataFrame], some: Column) -> DataFrame:
        """``near`` with bounds from what each probe's nearest cell meets, without the cells that are farther off."""
        nearest = near.groupBy("probe").agg(F.min_by(F.struct(*(n for n in near.columns if n != "probe")), "least").alias("x")).select("probe", "x.*")
        bounds = met(nearest).groupBy("probe").agg(F.min(some).alias("some"))
        near = near.join(bounds.hint("merge"), "probe").withColumn("bound", F.least("bound", "some")).drop("some")
        return near.filter(within(c("least")))

    def left(near: DataFrame, table: DataFrame, by: int | None) -> DataFrame:
        """The cells of ``table`` inside those of ``near``, by shifts of ``by`` (none: all cells), that may hold the best row."""
        least = sum(((F.greatest(c(f"low{i}").cast("double") - x, x - c(f"high{i}").cast("double"), F.lit(0.0)) / F.greatest(x, F.lit(1.0))) for i, x in enumerate(own)), F.lit(0.0))
        some = sum(((F.abs(c(f"one{i}").cast("double") - x) / F.greatest(x, F.lit(1.0))) for i, x in enumerate(own)), F.lit(0.0))
        table = table if by is None else table.withColumns({f"w{i}": F.shiftright(f"c{i}", by) for i in each})
        met = lambda near: near.join(table.hint("merge"), [on] if by is None else [on, *(f"w{i}" for i in each)])
        if by is not None:
            near = tight(near.withColumnsRenamed({f"c{i}": f"w{i}" for i in each}), met, some)
        pairs = met(near.drop("least")).filter(within(least))
        return stored(pairs.select("probe", on, *(f"p_{f}" for f in features), *cells, "bound", least.alias("least")), "near")

    sizes = h.agg(F.count("*").alias("n"), *(F.approx_count_distinct(F.xxhash64(on, *at(s))).alias(f"n{s}") for s in SHIFTS)).first()
    first, last = (next((s for s in SHIFTS if sizes[f"n{s}"] * least <= sizes["n"]), SHIFTS[-1]) for least in (CELL_ROWS, LAST_ROWS))
    near, by, table = p.withColumn("bound", F.lit(float("inf"))), None, counted(h, first)
    for shift in (s for s in reversed(SHIFTS) if s >= first):
        near, by = left(near, wider(table, shift - first) if shift > first else table, by), 2
    wanted = near.select(F.xxhash64(on, *cells).alias("cell")).distinct()
    h = h.withColumn("cell", F.xxhash64(on, *at(first))).join(wanted.hint("merge"), "cell", "left_semi").drop("cell")
    h = stored(h.groupBy(on, *(f"h_{f}" for f in features)).agg(F.min_by("kept", f"kept.{order}").alias("kept")), "history")
    if first > last:
        table = counted(h, last)
        for shift in (s for s in reversed(SHIFTS) if last <= s < first):
            near = left(near, wider(table, shift - last) if shift > last else table, 2)
    rows = h.select("*", *(x.alias(n) for x, n in zip(at(last), cells))).hint("merge")
    met = lambda near: near.join(rows, [on, *cells])
    found = met(tight(near, met, relative_score(features))).withColumn("score", relative_score(features)).filter(within(c("score")))
    best = best_by(found, ["probe"], [c("score"), c(f"kept.{order}")], [*(f"kept.{k}" for k in keep), "score"])
    best = p.withColumnsRenamed({f"p_{f}": f for f in features}).join(best.hint("merge"), "probe").drop("probe")
    return probes.select("id", *spot).join(best.hint("merge"), spot).select("id", *keep, "score")
