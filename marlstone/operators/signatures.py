"""Near signatures: bit strings of 64 bits, and arrays of them, within a Hamming distance; signatures of words and of
matrices.

The bits are cut into ``t + r`` bands, of which two signatures at most ``t`` bits apart share ``r`` at least, so a row's keys
are its bits in every ``r`` bands.  A pair is met under several keys and taken under the first, the one of its lowest shared
bands, so nothing is made distinct afterwards.  A key that more than ``most`` rows share is narrowed by the keys of another
cut of the bits, which hold for a pair as well; what shares keys of all cuts is compared.  Keys that narrow have one band
only, and so have few rows for each: most of what shares a large key is near, and is compared in any case.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb, cos, pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored

BITS = 64
#: Keys of a row in one cut, and rows of a key beyond which it is narrowed.
MOST_KEYS, MOST_ROWS = 120, 32_768
#: Bands of a key in each cut, at most: of signatures, and of the places of arrays, of which there are more and which share
#: fewer keys.
BANDS, PLACE_BANDS = (3, 1, 1), (2, 1, 1)
#: Orders in which the bits are cut into bands: as they are, by their place in a byte, and by every 13th.
ORDERS = (range(BITS), sorted(range(BITS), key=lambda i: (i % 8, i)), [i * 13 % BITS for i in range(BITS)])


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def banded(threshold: int, order: int, most: int = 3) -> tuple[int, list[int]]:
    """How many bands a key of one cut of the bits has, ``most`` at most, and the masks of all bands."""
    if not 0 <= threshold < BITS:
        raise ValueError(f"a threshold of 0 to {BITS - 1} bits, not {threshold}")
    r = next((r for r in range(most, 1, -1) if comb(threshold + r, r) <= MOST_KEYS), 1)
    n = threshold + r
    places = list(ORDERS[order])
    return r, [sum(1 << i for i in places[k * BITS // n : (k + 1) * BITS // n]) for k in range(n)]


def cut(threshold: int, order: int, most: int = 3) -> tuple[list[int], list[list[int]]]:
    """The masks of the keys of ``most`` bands at most in one cut of the bits, and for each the masks of the lower bands it
    leaves out."""
    r, bands = banded(threshold, order, most)
    masks, skipped = [], []
    for chosen in combinations(range(len(bands)), r):
        masks.append(sum(bands[k] for k in chosen))
        skipped.append([bands[k] for k in range(chosen[-1]) if k not in chosen])
    return masks, skipped


def keyed(rows: DataFrame, threshold: int, order: int, sig: str = "s", bands: tuple[int, ...] = BANDS) -> DataFrame:
    """``rows`` once for each key of a cut: ``c<order>``, the key's number, and ``v<order>``, its bits."""
    masks, _ = cut(threshold, order, bands[order])
    keys = F.array(*(F.struct(F.lit(i).alias("c"), F.lit(signed(m)).alias("m")) for i, m in enumerate(masks)))
    rows = rows.withColumn("_key", F.explode(keys))
    return rows.withColumn(f"c{order}", F.col("_key.c")).withColumn(f"v{order}", F.col(sig).bitwiseAND(F.col("_key.m"))).drop("_key")


def first_key(threshold: int, order: int, differing: Column, key: Column, bands: tuple[int, ...] = BANDS) -> Column:
    """Whether a key is the first that a pair shares: up to its last band, its own are all that agree.  Pairs that agree in
    most bands are asked this under most of their keys, so it is plain arithmetic, which Spark compiles."""
    r, masks = banded(threshold, order, bands[order])
    chosen = list(combinations(range(len(masks)), r))
    long = lambda x: F.lit(signed(x)).cast("bigint")
    at = lambda xs: F.get(F.array(*map(long, xs)), key)
    agree = reduce(Column.bitwiseOR, (F.when(differing.bitwiseAND(long(m)) == 0, long(1 << k)).otherwise(long(0)) for k, m in enumerate(masks)))
    return agree.bitwiseAND(at((2 << c[-1]) - 1 & (1 << BITS) - 1 for c in chosen)) == at(sum(1 << k for k in c) for c in chosen)


def meetings(left: DataFrame, right: DataFrame, threshold: int, on: list[str], test: Column, most: int = MOST_ROWS, bands: tuple[int, ...] = BANDS) -> DataFrame:
    """(a, b, and the columns of ``test``) of the rows (id, s, ...) whose signatures are at most ``threshold`` bits apart, that
    agree in ``on`` and pass ``test`` on ``l.`` and ``r.``; one row for each pair of rows.  Both sides are shuffled:
    Spark's estimate of a side leaves out that a row has many keys, and would send it whole through the driver."""

    def level(left: DataFrame, right: DataFrame, order: int, keys: list[str]) -> DataFrame:
        same_rows = left is right
        left, right = (keyed(x, threshold, order, bands=bands) for x in (left, right))
        right = right.select(*(F.col(c).alias(c) for c in right.columns))  # both may be one table
        keys = [*keys, f"c{order}", f"v{order}"]
        deeper = None
        if order + 1 < len(ORDERS):
            both = left.select(keys) if same_rows else left.select(keys).unionByName(right.select(keys))
            hot = stored(both.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > (most if same_rows else 2 * most)).select(keys), "hot")
            if not hot.isEmpty():
                own = left.join(hot, keys)
                deeper = level(own, own if same_rows else right.join(hot, keys), order + 1, keys)
                left, right = left.join(hot, keys, "left_anti"), right.join(hot, keys, "left_anti")
        same = reduce(Column.__and__, (F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys))
        differing = F.col("l.s").bitwiseXOR(F.col("r.s"))
        first = (first_key(threshold, i, differing, F.col(f"l.c{i}"), bands) for i in range(order + 1))
        near = reduce(Column.__and__, first, test & (F.bit_count(differing) <= threshold))
        chosen = left.alias("l").join(right.alias("r").hint("merge"), same).filter(near).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), differing.alias("x"))
        return chosen if deeper is None else chosen.unionByName(deeper)

    if not threshold:  # equal ones
        same = reduce(Column.__and__, (F.col(f"l.{k}") == F.col(f"r.{k}") for k in [*on, "s"]))
        return left.alias("l").join(right.alias("r"), same).filter(test).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), F.lit(0).cast("bigint").alias("x"))
    return level(left, right, 0, on)


def classes_of(rows: DataFrame, item: str, sig: str) -> DataFrame:
    """(id, s, n) of the distinct signatures: the least item that has one, and how many have it."""
    rows = rows.filter(F.col(sig).isNotNull())
    return stored(rows.groupBy(F.col(sig).alias("s")).agg(F.min(item).alias("id"), F.count("*").alias("n")).select("id", "s", "n"), "classes")


def members(rows: DataFrame, item: str, sig: str) -> DataFrame:
    """(item, class_id): each item with the least item that has its signature."""
    return rows.filter(F.col(sig).isNotNull()).join(classes_of(rows, item, sig).select(F.col("s").alias(sig), F.col("id").alias("class_id")), sig).select(item, "class_id")


def near_classes(classes: DataFrame, threshold: int, most: int = MOST_ROWS) -> DataFrame:
    """(a, b, distance) of the distinct signatures (id, s) at most ``threshold`` bits apart, a < b: the representatives of
    classes of equal ones, whose members :func:`members` lists."""
    sigs = classes.select("id", "s")
    found = meetings(sigs, sigs, threshold, [], F.col("l.id") < F.col("r.id"), most)
    return found.select("a", "b", F.bit_count("x").alias("distance"))


def mean_distance(a: Column, b: Column) -> Column:
    """The mean bit distance of two arrays, the shorter padded with its last value, to the nearest even whole number."""
    n = F.greatest(F.size(a), F.size(b))
    pad = lambda x: F.concat(x, F.array_repeat(F.element_at(x, -1), n - F.size(x)))
    bits = F.zip_with(pad(a), pad(b), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.bround(F.aggregate(bits, F.lit(0).cast("bigint"), lambda s, x: s + x) / n).cast("int")


def near_arrays(classes: DataFrame, threshold: int, most: int = MOST_ROWS) -> DataFrame:
    """(a, b, distance) of the distinct arrays of signatures (id, s) whose mean distance, rounded, is at most ``threshold``,
    a < b.  Empty arrays are near nothing.

    If the mean of whole numbers is within ``threshold`` and a half, one of them is within ``threshold``: two such arrays have
    an aligned place at most so many bits apart, either a place of both, or one of the longer past the end of the
    shorter, which stands there with its last value.  Places are found like single signatures, then whole arrays are compared."""
    arrays = classes.filter(F.size("s") > 0).select("id", F.col("s").alias("all"), F.size("s").alias("size"))
    places = arrays.select("id", F.posexplode("all").alias("place", "s"))
    aligned = meetings(places, places, threshold, ["place"], F.col("l.id") < F.col("r.id"), most, PLACE_BANDS)
    ends = arrays.select("id", "size", F.element_at("all", -1).alias("s"))
    past = meetings(ends, places.filter("place > 0"), threshold, [], F.col("r.place") >= F.col("l.size"), most, PLACE_BANDS)
    pair = lambda found: found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = pair(aligned).unionByName(pair(past)).distinct()
    side = lambda item, name: arrays.select(F.col("id").alias(item), F.col("all").alias(name)).hint("merge")
    whole = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    return whole.select("a", "b", mean_distance(F.col("x"), F.col("y")).alias("distance")).filter(F.col("distance") <= threshold)


def word_signatures(words: DataFrame, keys: list[str], word: str = "word") -> DataFrame:
    """(keys, sig): the bits that most of a key's words have set in the first 64 bits of their MD5 sum; of as many, none.
    Two bits are counted in one number, 32 bits apart."""
    h = words.select(*keys, F.conv(F.substring(F.md5(word), 1, 16), 16, -10).cast("bigint").alias("h"))
    half = BITS // 2
    ones = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(1 << half | 1))).alias(f"b{i}") for i in range(half)]
    sums = h.groupBy(*keys).agg(F.count("*").alias("n"), *ones)
    count = lambda i: F.col(f"b{i}").bitwiseAND(F.lit((1 << half) - 1)) if i < half else F.shiftrightunsigned(f"b{i - half}", half)
    bits = [F.when(2 * count(i) > F.col("n"), F.lit(signed(1 << i))).otherwise(F.lit(0)).cast("bigint") for i in range(BITS)]
    return sums.select(*keys, reduce(Column.bitwiseOR, bits).alias("sig"))


def cosine_block(flat: Column, side: int, low: int) -> Column:
    """The ``low`` x ``low`` lowest frequencies, row by row, of the two-dimensional cosine transform of a ``side`` x ``side`` matrix
    that is given row by row: columns are transformed first, then the rows of what is left."""
    wave = [[2 * cos(pi * (2 * x + 1) * u / (2 * side)) for x in range(side)] for u in range(low)]
    waves = F.array(*(F.array(*map(F.lit, w)) for w in wave))
    dot = lambda values, w: F.aggregate(F.zip_with(values, w, lambda v, c: v * c), F.lit(0.0), lambda s, x: s + x)
    column = lambda x: F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda y: F.get(flat, y * side + x).cast("double"))
    columns = F.transform(F.sequence(F.lit(0), F.lit(side - 1)), column)
    half = F.transform(waves, lambda w: F.transform(columns, lambda c: dot(c, w)))
    return F.flatten(F.transform(half, lambda row: F.transform(waves, lambda w: dot(row, w))))


def above_median(values: Column) -> Column:
    """A bit for each value, 1 where it is over the median, as text; the mean of the two middle ones is that of an even number."""
    s, n = F.sort_array(values), F.size(values)
    median = (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
    return F.element_at(F.transform(F.array(median), lambda m: F.array_join(F.transform(values, lambda v: F.when(v > m, "1").otherwise("0")), "")), 1)


def matrix_signature(flat: Column, side: int = 8, low: int = 4) -> Column:
    """Bits of the low frequencies over their median; null where the matrix has not side * side numbers or holds a null."""
    whole = (F.size(flat) == side * side) & F.forall(flat, lambda x: x.isNotNull())
    return F.when(whole, above_median(cosine_block(flat, side, low)))
