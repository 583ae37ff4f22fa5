"""Decision rules of the encode searches, as expressions over a state row.

State columns: it (iteration from 0), source (stats, neighbor stats, delta_avg, formula), fast and predicted (MB), med (MB,
the expensive encode), scale, low, high, frames, pixels, colors, delta, bias.  Every rule gives null where it doesn't
apply, so that a search step is a ``coalesce`` of rules in order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.rules import MID, PREFERRED, TARGET_MAX, TARGET_MIN, bracket_clamp, clamp, in_band, preferred, step_cap

C = F.col


def _guess() -> Column:
    return C("source").isin("formula", "neighbor stats")


def _moved(scale: Column, least: float) -> Column:
    """A new scale, if strictly in the bracket and more than ``least`` away."""
    return F.when((scale > C("low")) & (scale < C("high")) & (F.abs(scale - C("scale")) > least), scale)


def fast_accept() -> Column:
    """Why the cheap encode is final."""
    direct = (C("it") == 0) & in_band(C("fast")) & (C("frames") >= 120)
    return F.when(direct, "direct").when((C("it") >= 1) & preferred(C("fast")), "preferred")


def hard_skip_scale() -> Column:
    """The cheap encode alone is far over: the next scale from it."""
    by_delta = MID - C("delta") * C("bias")
    known = (C("source") == "neighbor stats") & (by_delta > 0)
    scale = F.when(known, C("scale") * F.sqrt(F.when(known, by_delta) / C("fast"))).otherwise(C("scale") * F.sqrt(MID / C("fast")) * 0.92)
    scale = F.when(C("frames") >= 400, scale * 0.90).otherwise(scale)
    capped = step_cap(C("scale"), scale, 0.75)
    return F.when((C("it") == 0) & _guess() & (C("fast") > 1.30 * TARGET_MAX), bracket_clamp(capped, C("low"), C("scale")))


def skip_scale(low: Column, high: Column) -> Column:
    """The next scale after a skipped encode."""
    return bracket_clamp(step_cap(C("scale"), C("scale") * F.sqrt(MID / C("predicted")), 0.45), low, high)


def under_target_scale(most_iterations: int = 10) -> Column:
    under = (C("source") == "formula") & (C("predicted") < TARGET_MIN - 0.35) & (C("fast") < TARGET_MIN) & (C("it") < most_iterations - 1)
    scale = step_cap(C("scale"), C("scale") * F.sqrt(MID / F.greatest(C("predicted"), F.lit(0.1))), 0.30)
    return F.when(under, bracket_clamp(scale, F.greatest(C("low"), C("scale")), C("high")))


def pre_correct_scale() -> Column:
    return F.when((C("it") == 0) & (C("source") == "delta_avg") & (C("fast") < 0.8 * MID) & (C("predicted") < 0.92 * TARGET_MIN), C("scale") * 0.92)


def soft_shrink_scale() -> Column:
    """A small step down before the first expensive encode of a prediction that is slightly over."""
    p, f = C("predicted"), C("fast")
    wish = C("scale") * F.sqrt(MID / p) * 0.99
    formula = (C("source") == "formula") & (p > 0.985 * TARGET_MAX) & (p <= 1.20 * TARGET_MAX) & (f > 0.80 * TARGET_MAX)
    stats = (C("source") == "stats") & (C("colors") >= 220) & p.between(0.995 * TARGET_MAX, 1.20 * TARGET_MAX) & (f > 0.70 * TARGET_MAX)
    scale = F.when(formula, step_cap(C("scale"), wish, 0.12)).when(stats, step_cap(C("scale"), wish, 0.10))
    return F.when(C("it") == 0, _moved(scale, 0.005))


def micro_adjust_scale() -> Column:
    fits = (C("source") == "neighbor stats") & (C("predicted") < TARGET_MIN) & (C("fast") < 0.9 * MID) & (C("it") <= 1) & (C("frames") >= 80) & (C("high") >= 3.9)
    scale = step_cap(C("scale"), C("scale") * F.sqrt(MID / (C("fast") + 4)), 0.30)
    return F.when(fits & (F.abs(scale - C("scale")) > 0.01), scale)


def temporal_step() -> Column:
    """Fewer frames instead of fewer pixels: ``preserve`` when over, ``retry`` when in the band at a very small scale."""
    long_small = (C("frames") >= 360) & (C("pixels") <= 100_000)
    return F.when((C("it") == 0) & long_small & (C("med") > TARGET_MAX) & (C("scale") < 0.85), "preserve").when((C("it") == 0) & long_small & in_band(C("med")) & (C("scale") < 0.70), "retry")


def keep_every() -> Column:
    return clamp(F.bround(C("med") / MID), 2, 3).cast("int")


def finished() -> Column:
    return in_band(C("med")) | ((C("it") >= 1) & C("med").between(*PREFERRED))


def advanced_scale() -> Column:
    """The scale after an expensive encode: the step-capped root correction in the new bracket, else its midpoint."""
    low, high = F.when(C("med") > TARGET_MAX, C("low")).otherwise(C("scale")), F.when(C("med") > TARGET_MAX, C("scale")).otherwise(C("high"))
    wish = step_cap(C("scale"), C("scale") * F.sqrt(MID / C("med")), 0.35)
    return F.when((wish > low) & (wish < high), wish).otherwise(step_cap(C("scale"), (low + high) / 2, 0.15))


def secant_scale(low: Column, high: Column, med_low: Column, med_high: Column, scale: Column, ratio: float = 0.15) -> Column:
    """Between two measured ends, if within a step of the scale."""
    x = low + (MID - med_low) * (high - low) / F.when(med_high != med_low, med_high - med_low)
    return F.when((low != high) & (F.abs(x - scale) <= scale * ratio), x)


def nudged_quality(quality: Column, size: Column, under: Column, over: Column) -> Column:
    """One or two steps of quality near the middle, while the bracket is open; up to three while all were under."""
    miss = F.abs(size - MID) / MID
    step = F.when(miss <= 0.04, 1).otherwise(2)
    step = F.when(under.isNotNull() & over.isNull(), F.greatest(step, clamp(F.ceil(miss / 0.0125).cast("int"), 1, 3))).otherwise(step)
    moved = F.when(size > MID, quality - step).otherwise(quality + step)
    return F.when((miss <= 0.10) & (under.isNull() | over.isNull()), clamp(moved, 45, 100))


def floor_size(quality: Column, size: Column, alpha: Column, floor: int = 45) -> Column:
    """Size at the lowest quality under the fitted exponent, 1 without a fit."""
    ratio = F.greatest(F.lit(0.01), F.lit(floor) / F.greatest(F.lit(1), quality))
    return F.when((quality > 0) & (size > 0), size * F.pow(ratio, F.coalesce(alpha, F.lit(1.0))))


def early_resize(quality: Column, size: Column, alpha: Column, next_quality: Column, under: Column, over: Column) -> Column:
    return under.isNull() & over.isNotNull() & (next_quality <= 45) & (floor_size(quality, size, alpha) > 1.05 * TARGET_MAX)


def resize_factor(quality: Column, size: Column) -> Column:
    return F.when(quality <= 45, clamp(F.sqrt(MID / size), 0.80, 0.95))


def refine_in_band(size: Column, under: Column, over: Column, attempts_left: Column) -> Column:
    """Whether a result in the band is bisected further towards the middle."""
    return (F.abs(size - MID) / MID > 0.04) & (attempts_left > 0) & (over - under > 1)


def probe_raise(predicted: Column, fast: Column, ratio: Column) -> Column:
    """A measured size ratio above 1 only raises a prediction."""
    return F.when(ratio > 1, F.greatest(predicted, fast * ratio)).otherwise(predicted)


def direct_fast(init: Column, growth: float = 1.10, safety: float = 0.96) -> Column:
    """Whether a file's first encode may go straight to the fast method: expected growth stays under the limit."""
    return init * growth <= TARGET_MAX * safety


def encoder_method(method: Column) -> Column:
    return clamp(method, 0, 6)


def exploratory_fast(direct: Column, frames: Column, method: Column, fast_method: Column, enabled: bool = True, least_frames: int = 120) -> Column:
    """Whether the first encodes of a long file, not known from statistics, may use the fast method."""
    return F.lit(enabled) & ~direct & (F.coalesce(frames, F.lit(0)) >= least_frames) & (encoder_method(method) != encoder_method(fast_method))
