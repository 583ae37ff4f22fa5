"""Scalar rules as column expressions.  Rounding is half-even throughout (``bround``), division of counts is exact."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The size band in MB, its tolerance and preferred part, and the static limit in bytes.
TARGET_MIN, TARGET_MAX, TOLERANCE = 13.5, 14.99, 0.005
PREFERRED = (13.8, 14.6)
PROCESS_ABOVE = 15.0
STATIC_BYTES = 999 * 1024
MB = 1024 * 1024
MID = (TARGET_MIN + TARGET_MAX) / 2


def col(x: Column | float | str) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    """``x`` within bounds; an unknown one stays unknown (least and greatest skip nulls)."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, col(high)), col(low)))


def in_band(x: Column) -> Column:
    return x.between(TARGET_MIN, TARGET_MAX + TOLERANCE)


def preferred(x: Column) -> Column:
    return x.between(*PREFERRED)


def bucketize(x: Column, step: float) -> Column:
    """The nearest multiple of ``step``; null stays null."""
    return F.bround(x / F.lit(float(step))) * F.lit(float(step))


def even_indices(n: Column, k: int) -> Column:
    """At most ``k`` evenly spaced indices of 0..n-1 with both ends, without repeats."""
    spread = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (n - 1) / F.lit(max(1, k - 1))).cast("int")))
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= k, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(spread)


def even_starts(n: Column, k: int) -> Column:
    """``k`` evenly spaced indices of 0..n-1 without the end."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * n / k).cast("int"))


def strided(values: Column, k: int) -> Column:
    """Every ``max(1, size // k)``-th value, ``k`` at most."""
    stride = F.greatest(F.lit(1), F.floor(F.size(values) / k).cast("int"))
    return F.slice(F.filter(values, lambda x, i: i % stride == 0), 1, k)


def sample_size(n: Column, low: int = 12, high: int = 36) -> Column:
    """All of a few frames, else 1.25 times the root of their number, within bounds."""
    return F.when(n <= low, n).otherwise(clamp((F.sqrt(n) * 1.25).cast("int"), low, high))


def clamp_prediction(p: Column, fast: Column) -> Column:
    """A predicted size within 0.3 to 2 times the fast one's; unknown where either is."""
    return F.when(p.isNotNull() & fast.isNotNull(), F.least(F.greatest(p, fast * 0.3, F.lit(0.1)), fast * 2))


def suggested_scale(scale: Column, target: Column | float, size: Column) -> Column:
    target = col(target)
    return F.when((size > 0) & (target > 0), F.greatest(F.lit(0.01), scale * F.sqrt(target / size))).otherwise(F.greatest(F.lit(0.01), scale))


def step_cap(scale: Column, suggested: Column, ratio: Column | float) -> Column:
    ratio = col(ratio)
    step = scale * ratio
    return F.when(ratio <= 0, scale).when(F.abs(suggested - scale) <= step, suggested).otherwise(scale + F.signum(suggested - scale) * step)


def bracket_clamp(x: Column, low: Column, high: Column) -> Column:
    return F.when((low < high) & (x > low) & (x < high), x).otherwise((low + high) / 2)


def safe_scale(scale: Column, target: Column | float, size: Column, ratio: Column | float, low: Column, high: Column) -> Column:
    """Suggested, step-capped and kept in the bracket."""
    return bracket_clamp(step_cap(scale, suggested_scale(scale, target, size), ratio), low, high)


def long_bias(scale: Column, frames: Column, size_mb: Column) -> Column:
    return F.when((frames >= 400) & (size_mb >= 20), scale * 0.88).when((frames >= 250) & (size_mb >= 50), scale * 0.93).otherwise(scale)


def seeded_quality(size: Column, target: Column | float, low: int, high: int, bias: float = 1.02) -> Column:
    ratio = F.when(size > 0, F.sqrt(col(target) / size)).otherwise(1.0)
    return clamp((ratio * high * bias).cast("int"), low, high)


def frame_timeout(frames: Column, cap: float = 3600.0, floor: float = 600.0, per_frame: float = 0.52) -> Column:
    return F.least(F.lit(cap), F.greatest(F.lit(floor), F.coalesce(frames, F.lit(0)) * per_frame))


def corrected_quality(quality: Column, predicted: Column, target: Column, alpha: float = 1.35, factor: float = 1.20, steps: int = 12) -> Column:
    """Quality moved to meet ``target`` under size = C * q**alpha; upward moves are capped, moves under 3 ignored."""
    raw = clamp((quality * F.pow(target / predicted, F.lit(1 / max(0.2, alpha)))).cast("int"), 45, 100)
    capped = F.when(raw > quality, F.least(raw, (quality * factor).cast("int"), quality + steps, F.lit(100))).otherwise(raw)
    return F.when((predicted > 0) & (F.abs(capped - quality) >= 3), capped)


def ratio_bias(palette: Column) -> Column:
    return 1.1 + palette * 0.05 / 256


def fraction(text: Column) -> Column:
    """``n/d`` as a double; a denominator under 1 counts as 1."""
    parts = F.split(text, "/")
    return F.get(parts, 0).cast("double") / F.greatest(F.lit(1.0), F.coalesce(F.get(parts, 1).cast("double"), F.lit(1.0)))


def extrapolated_size(probe: Column, sampled: Column, frames: Column, bias: float = 1.02) -> Column:
    """The size of all frames from the size of a sample."""
    return probe / sampled * frames * bias


def probe_target(init: Column, mid: Column | float = MID, most: Column | float = TARGET_MAX) -> Column:
    """The size a probe steers to: never nearer than 3 per cent to the source's."""
    return F.when(init.isNotNull(), F.least(col(mid), col(most), F.when(init > 0, init * 0.97).otherwise(col(mid)))).otherwise(F.least(col(mid), col(most)))


def scale_key(scale: Column) -> Column:
    return F.bround(scale, 4)


def quotename(x: Column) -> Column:
    return F.concat(F.lit("["), F.replace(x, F.lit("]"), F.lit("]]")), F.lit("]"))


def quoted(x: Column) -> Column:
    return F.replace(x, F.lit("'"), F.lit("''"))


def hex_key(parts: Column) -> Column:
    """64-bit values as 16 hex digits each, joined by bars."""
    return F.concat_ws("|", F.transform(parts, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")))


def hamming(a: Column, b: Column) -> Column:
    """Mean bit distance of two signature arrays; the shorter is padded with its last value."""
    n = F.greatest(F.size(a), F.size(b))
    pad = lambda x: F.concat(x, F.array_repeat(F.element_at(x, -1), n - F.size(x)))
    bits = F.zip_with(pad(a), pad(b), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.bround(F.aggregate(bits, F.lit(0), lambda s, x: s + x) / n).cast("int")


def sign_bits(vector: Column) -> Column:
    """The signs of up to 64 numbers as the bits of a long, the first the highest; not negative is 1."""
    return F.aggregate(vector, F.lit(0).cast("bigint"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(F.when(x >= 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint")))


def statement_slice(text: Column, start: Column, end: Column) -> Column:
    """Text between two byte offsets of two-byte characters, ``(end - start) / 2 + 1`` of them with the quotient cut towards
    zero.  An end of -1, which marks the end of a batch, gets no rule of its own: the length is then 0 or 1 for a start
    under 4, and negative beyond, which is an error where the rule comes from and an empty text here."""
    half = lambda x: F.when(x < 0, F.ceil(x / 2)).otherwise(F.floor(x / 2)).cast("int")
    return F.substring(text, half(start) + 1, F.greatest(F.lit(0), half(end - start) + 1))


def size_label(n_bytes: Column) -> Column:
    """Half-even like all rounding here; the formatter alone would round halves up."""
    return F.when(n_bytes >= MB, F.format_string("%.2f MB", F.bround(n_bytes / MB, 2))).otherwise(F.format_string("%.1f KB", F.bround(n_bytes / 1024, 1)))


def duration_label(seconds: Column) -> Column:
    return F.when(seconds >= 60, F.format_string("%dm %ds", F.floor(seconds / 60), F.floor(seconds % 60))).otherwise(F.format_string("%.1fs", seconds))


def short_label(text: Column, width: int) -> Column:
    return F.when(F.length(text) > width, F.concat(F.lit("..."), F.right(text, F.lit(width - 3)))).otherwise(F.rpad(text, width, " "))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def with_suffix(path: Column, new: str) -> Column:
    return F.concat(F.regexp_replace(path, r"\.[^./]+$", ""), F.lit(new))


def top_folder(path: Column) -> Column:
    """The first folder of a relative path; files at the root form a group of their own."""
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise(F.lit("."))


def parent_folder(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit("."))


def proxy_estimate(mb: Column, width: Column, proxy_width: Column, fps: Column, proxy_fps: Column, bias: float = 2.0) -> Column:
    return mb * (width / proxy_width) * (fps / proxy_fps) * bias


def day_floor(now: Column, days: int = 3) -> Column:
    return F.date_trunc("day", now) - F.make_dt_interval(F.lit(days))
