"""Operator 2: document fingerprints from closed syncmers, in built-in functions only.

Words are runs of at most ``WORD`` characters that aren't white space.  A longer run is not cut, which would make its
words depend on where it begins: each of its characters starts a word of ``PART`` characters (fewer at the run's end),
so that an edit touches only the words around it, at the price of a word for each character.  A k-mer of four words has three inner pairs;
it is a closed syncmer if the least hashed pair lies at an edge.  Whether it is depends on its own words alone, so an
edit changes only the anchors it touches.  An anchor is the k-mer's 64-bit hash; the fingerprint lists every anchor of
the whole text in order, and an empty place for each k-mer that is none, so that it has the positions too.

Two texts are matched by all their anchors and by the order of these: the parts of a text are its anchors and its
links, a link being two successive anchors and the distance of their positions.  Neither depends on where in the text
it stands, so a passage matches wherever it has moved to.  Equal parts of a text are counted, and the likeness is
common parts / (parts of both - common parts).

Edge cases: a null text is empty; a text without a closed syncmer, as one of one to three words and some of four, has one
anchor, the whole sequence, an empty or blank text none; two texts without anchors are alike (1), one without is unlike any other (0); repeated ids are
ordered by their text's hash, equal rows follow each other, null ids come last; texts are read whole; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import stored
from .windows import NO_ID, texts_of

#: Characters of a word and of a word in a longer run, words of a k-mer.
WORD, PART, K = 24, 8, 4
#: The words of a longer run, as group 1.
LONG = rf"(?=(\S{{1,{PART}}}))\S"
#: A text's last run, and the first, which may be empty.
LAST, FIRST = r"(?<!\S)\S*+\z", r"^\S*+"
#: Documents of a bucket of neighbouring ids; buckets beyond which these grow instead.
BUCKET_DOCS, MAX_BUCKETS = 1500, 1 << 17


def no_words() -> Column:
    return F.array().cast("array<bigint>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(run: Column) -> Column:
    """The hashes of the words of a run without white space, array<bigint>: one of up to ``WORD`` characters is a word."""
    long = F.transform(F.regexp_extract_all(run, F.lit(LONG), F.lit(1)), lambda w: F.xxhash64(w))
    return F.when(run == "", no_words()).when(F.length(run) <= WORD, F.array(F.xxhash64(run))).otherwise(long)


def kmers(h: Column) -> Column:
    """The closed syncmers of words (their hashes) in order, as array<bigint>; null where the k-mer at that word is none."""

    def of_pairs(s: Column) -> Column:
        def kmer(i: Column) -> Column:
            inner = F.get(s, i + 1)
            return F.when((inner >= F.get(s, i)) | (inner >= F.get(s, i + 2)), F.xxhash64(F.get(s, i), F.get(s, i + 2)))

        return F.transform(F.sequence(F.lit(0), F.size(s) - 3), kmer)

    pairs = F.zip_with(F.slice(h, F.lit(1), F.size(h) - 1), F.slice(h, F.lit(2), F.size(h) - 1), lambda a, b: F.xxhash64(a, b))
    return F.when(F.size(h) >= K, let(pairs, of_pairs)).otherwise(no_words())


def with_fallback(found: Column, h: Column) -> Column:
    """``found``, or one anchor, the whole sequence, where words have no closed syncmer."""
    few = F.array(F.aggregate(h, F.lit(0).cast("bigint"), lambda acc, x: F.xxhash64(acc, x)))
    return F.when(F.exists(found, lambda x: x.isNotNull()) | (F.size(h) == 0), found).otherwise(few)


def hashed(texts: DataFrame, text: str = "text") -> DataFrame:
    """``texts`` with ``sizes``, the number of words between white-space characters, ``words``, their hashes, ``kmers``,
    their closed syncmers, and ``found``, the anchors: each text is read once."""
    texts = texts.withColumn("runs", F.split(text, r"\s", -1))
    texts = texts.withColumn("words", F.flatten(F.transform("runs", words_of)))
    small = lambda r: F.when(r == "", 0).when(F.length(r) <= WORD, 1).otherwise(F.length(r))
    texts = texts.withColumn("sizes", F.transform("runs", small)).drop("runs")
    texts = texts.withColumn("kmers", kmers(F.col("words")))
    return texts.withColumn("found", with_fallback(F.col("kmers"), F.col("words")))


def anchor_list(found: Column) -> Column:
    """(position, hash) of the anchors, in order."""
    return F.filter(F.transform(found, lambda h, i: F.struct(i.alias("position"), h.alias("hash"))), lambda x: x["hash"].isNotNull())


def counted(values: Column) -> Column:
    """An array's values made distinct: the first of equal ones stays, of the others the k-th becomes a hash of itself and k."""

    def numbered(s: Column) -> Column:
        first = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)), lambda i: i.isNotNull())

        def number(st: Column) -> Column:
            def of_run(i: Column, r: Column) -> Column:
                n = F.coalesce(F.get(st, r + 1), F.size(s)) - i
                return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.xxhash64(F.get(s, i), k))

            return F.flatten(F.transform(st, of_run))

        return let(first, number)

    again = let(F.sort_array(values), lambda s: F.filter(s, lambda x, i: x == F.get(s, i - 1)))
    return let(F.array_distinct(values), lambda d: F.when(F.size(d) == F.size(values), d).otherwise(F.concat(d, let(again, numbered))))


def parts(found: Column) -> Column:
    """The anchors and links of a text, equal ones told apart by number."""

    def linked(p: Column) -> Column:
        n = F.size(p) - 1
        pair = lambda a, b: F.xxhash64(a["hash"], b["hash"], b["position"] - a["position"])
        links = F.zip_with(F.slice(p, F.lit(1), n), F.slice(p, F.lit(2), n), pair)
        hashes = F.transform(p, lambda x: x["hash"])
        return F.when(n > 0, F.concat(hashes, links)).otherwise(hashes)

    return let(let(anchor_list(found), linked), counted)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, of two texts' parts."""
    common = let(F.size(F.array_intersect(a, b)), lambda c: c / (F.size(a) + F.size(b) - c))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(common)


def as_string(found: Column) -> Column:
    """Every k-mer's place in order: the anchor's hash, or nothing."""
    return F.array_join(F.transform(found, lambda x: F.lower(F.hex(x))), ",", "")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint, anchors): the general interface; ``anchors`` are (position, hash) for matching."""
    texts = hashed(texts_of(docs, id_col, text_col))
    doc_id = F.when(F.col("rid") != F.lit(NO_ID), F.col("rid")).alias("doc_id")
    return texts.select(doc_id, F.length("text").cast("long").alias("n_chars"), as_string(F.col("found")).alias("fingerprint"), anchor_list(F.col("found")).alias("anchors"))


def bucket_of(cuts: list[tuple[int, int]]) -> Column:
    """The number of cuts (rid, rhash) below a row, by a binary search in two constant arrays."""
    if not cuts:
        return F.lit(0)
    rids, rhashes = (F.split(F.lit(",".join(str(c[i]) for c in cuts)), ",").cast("array<bigint>") for i in range(2))
    rid, rhash = F.col("rid"), F.col("rhash")

    def step(at: Column, _: Column) -> Column:
        mid = F.shiftright(at["low"] + at["high"], 1)
        below = (F.get(rids, mid) < rid) | ((F.get(rids, mid) == rid) & (F.get(rhashes, mid) < rhash))
        low = F.when((at["low"] < at["high"]) & below, mid + 1).otherwise(at["low"])
        high = F.when((at["low"] < at["high"]) & ~below, mid).otherwise(at["high"])
        return F.struct(low.alias("low"), high.alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length() + 1)), start, step, lambda at: at["low"])


def with_next(texts: DataFrame) -> tuple[DataFrame, Window]:
    """``texts`` (rid, rhash, text, copies), a row for each id and text, dealt to buckets of neighbouring ids, with each
    bucket's follower as an extra row (``guest``), and the window in which a row's next document is the next row.

    Buckets are cut by (rid, rhash) and grow in number with the documents, so that rows of one id are dealt, too; equal rows
    are one row and a count.  The texts are shuffled once; cuts and followers come from a table of ids and hashes."""
    light = stored(texts.groupBy("rid", "rhash").agg(F.count("*").alias("copies")), "ids")
    n = light.count()
    size = min(MAX_BUCKETS, n // BUCKET_DOCS + 1)
    cuts: list[tuple[int, int]] = []
    if size > 1:
        # Each task of a range partitioning starts at a cut.
        ranges = light.select("rid", "rhash").repartitionByRange(size, "rid", "rhash").withColumn("part", F.spark_partition_id())
        starts = ranges.groupBy("part").agg(F.min(F.struct("rid", "rhash")).alias("cut"))
        cuts = sorted((r["cut"]["rid"], r["cut"]["rhash"]) for r in starts.collect())[1:]
    bucket = bucket_of(cuts)
    tops = light.groupBy(bucket.alias("bucket")).agg(F.max(F.struct("rid", "rhash")).alias("top"))
    down = Window.orderBy(F.col("bucket").desc())
    tops = tops.select(F.coalesce(F.lag("bucket").over(down), F.min("bucket").over(Window.partitionBy(F.lit(0)))).alias("target"), "top.*")
    many = light.filter("copies > 1")
    if many.isEmpty():
        once = texts.withColumn("copies", F.lit(1).cast("bigint"))
    else:
        found = texts.join(many.hint("shuffle_hash"), ["rid", "rhash"], "left")
        once = found.filter("copies is null").withColumn("copies", F.lit(1).cast("bigint"))
        once = once.unionByName(found.filter("copies is not null").dropDuplicates(["rid", "rhash"]))
    dealt = once.withColumn("bucket", bucket)
    guests = texts.join(F.broadcast(tops), ["rid", "rhash"]).groupBy("target").agg(*(F.first(c).alias(c) for c in ("rid", "rhash", "text")))
    guests = guests.withColumnRenamed("target", "bucket").withColumn("copies", F.lit(0).cast("bigint"))
    rows = dealt.withColumn("guest", F.lit(0)).unionByName(guests.withColumn("guest", F.lit(1)))
    return rows, Window.partitionBy("bucket").orderBy("guest", F.col("rid").desc(), F.col("rhash").desc())


def joined(rows: DataFrame) -> DataFrame:
    """``rows`` (sizes, words, kmers and the same of ``next``, head, tail) with ``kmers_e``, ``words_e`` of head + tail, where
    head starts the row's text and tail the next one's.  Words that white space ends on both sides are taken from the texts
    they come from, and so are the k-mers of such words; only those that reach over a cut are hashed."""
    c = F.col
    total = lambda values: F.aggregate(values, F.lit(0), lambda s, x: s + x)
    rows = rows.withColumn("gaps", F.regexp_count("tail", F.lit(r"\s")))
    # Words before the head's last run; words of the tail's first run; words of its runs up to the last.
    rows = rows.withColumn("a", total(F.slice("sizes", F.lit(1), F.regexp_count("head", F.lit(r"\s")))))
    inner = c("gaps") > 0
    rows = rows.withColumn("f", F.when(inner, F.get(c("next.sizes"), F.lit(0))).otherwise(0))
    rows = rows.withColumn("b", F.when(c("gaps") > 1, total(F.slice(c("next.sizes"), F.lit(2), c("gaps") - 1))).otherwise(0))
    rows = rows.withColumn("seam", words_of(F.concat(F.regexp_extract("head", LAST, 0), F.regexp_extract("tail", FIRST, 0))))
    rows = rows.withColumn("rest", F.when(inner, words_of(F.regexp_extract("tail", LAST, 0))).otherwise(no_words()))
    own, then = c("words"), c("next.words")
    rows = rows.withColumn("words_e", F.concat(F.slice(own, F.lit(1), c("a")), "seam", F.slice(then, c("f") + 1, c("b")), "rest"))
    near = K - 1
    across = kmers(F.concat(F.slice(own, F.greatest(c("a") - near, F.lit(0)) + 1, F.lit(near)), "seam", F.slice(then, c("f") + 1, F.lit(near))))
    after = kmers(F.concat(F.slice(then, F.greatest(c("f") + c("b") - near, F.lit(0)) + 1, F.lit(near)), "rest"))
    kept = F.concat(F.slice("kmers", F.lit(1), F.greatest(c("a") - near, F.lit(0))), across, F.slice(c("next.kmers"), c("f") + 1, F.greatest(c("b") - near, F.lit(0))), after)
    # Few words on a side: both cuts may fall into one k-mer.
    return rows.withColumn("kmers_e", F.when((c("a") >= near) & (c("b") >= 2 * near), kept).otherwise(kmers(c("words_e"))))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited text (its later half replaced by the start of the next document,
    descending id), and their likeness."""
    rows, order = with_next(texts_of(docs, id_col, text_col))
    # Texts are dealt before their words are hashed; the window then needs no other shuffle.
    rows = hashed(rows.repartition("bucket")).withColumn("parts", parts(F.col("found")))
    carried = ("text", "sizes", "words", "kmers", "parts")
    rows = rows.withColumn("next", F.lead(F.struct(*carried)).over(order)).filter("guest = 0")
    # A bucket's last row has none only if the table has one row, whose next text is then empty.
    none = F.struct(F.lit("").alias("text"), F.array(F.lit(0)).alias("sizes"), no_words().alias("words"), no_words().alias("kmers"), no_words().alias("parts"))
    last = F.struct(F.lit(1).cast("bigint").alias("times"), F.coalesce("next", none).alias("next"))
    # The next document of an equal row but the last is its own text again.
    others = F.struct((F.col("copies") - 1).alias("times"), F.struct(*carried).alias("next"))
    turns = F.when(F.col("copies") > 1, F.array(last, others)).otherwise(F.array(last))
    rows = rows.select("rid", "text", "sizes", "words", "kmers", "found", "parts", F.inline(turns))
    head, tail = F.expr("left(text, length(text) - length(text) div 2)"), F.expr("left(next.text, int(length(text) div 2))")
    rows = joined(rows.withColumn("head", head).withColumn("tail", tail))
    rows = rows.select(
        "rid", "times", F.length("text").cast("long").alias("n_chars"), F.sha2(F.concat("head", "tail"), 256).alias("edited_sha256"), as_string(F.col("found")).alias("fingerprint"),
        "parts", likeness(F.col("parts"), F.col("next.parts")).alias("near_next"), with_fallback(F.col("kmers_e"), F.col("words_e")).alias("edited"),
    )
    rows = rows.withColumn("edited_parts", parts(F.col("edited")))
    again = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))).alias("turn")
    return rows.select(
        F.when(F.col("rid") != F.lit(NO_ID), F.col("rid")).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", as_string(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("parts"), F.col("edited_parts")).alias("near_edited"), "near_next", again,
    ).drop("turn")
