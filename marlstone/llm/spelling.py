"""Operator 13: spelling variants, the words one edit apart, by merging an errata trie.

The words form a trie.  At every node that branches, the child with most words is the heavy one, and each light child is
merged into the others, small into large: a word of a light child is entered again

* with the letter that leads into that child replaced by the heavy child's letter, or left out, or with the heavy letter put
  in before it (which is the heavy side's words with their letter left out, entered from the smaller side), and
* with that letter open, to meet the words of other light children that agree in all else.

Where such an entry coincides with a word, or two open entries coincide, the two words are one edit apart; as the node where
two words part is one node, each pair is met once.  A word lies below light edges at most log2(words) times, so there are at
most four times as many entries for each word however alike the words are, and all that follows are joins and sums of entries:
pairs are never listed for a group.

Each step is a table: a row for a word's node at each depth, named by a hash of the prefix (equal names of different nodes
would only make one choice of the heavy child serve both); counts for each child; light edges; entries; and, for each word, the
number of its partners and the most frequent of these.  Forms are followed to their roots by doubling, as a form is at least
twice as frequent as its word.

Edge cases: a null text has no words; a null id counts as the empty text where ids are mixed in; repeated rows are
occurrences like any others; words of any length take time in proportion at each light edge; a word that no word is near is
its own root; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import scratch, stored
from .windows import mixed

#: Letters of a word, the fewest code points and occurrences of one, how many times as frequent a form is, and the divisor
#: of an occurrence's number where a letter is deleted.
LETTERS, LEAST_CHARS, LEAST_COUNT, RATIO, DELETES = "A-Za-z\\u00C0-\\u00FF", 5, 3, 2, 97
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters that are hashed together.
TOGETHER = 1 << 20
NODES = "node long, letter int, depth int, wid long"


def lowered(run: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def counted_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT,
    deletes: int = DELETES,
) -> DataFrame:
    """(word, n) of the words with enough code points and occurrences.  ``deletes``: see ``DELETES``; 0 for none."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{least_chars},}}+"), F.lit(0))).alias("run"))
    runs = runs.select("id", lowered(F.col("run")).alias("run"))
    word = F.col("run")
    if deletes:
        runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
        cut = F.concat(F.expr("left(run, int(h % length(run)))"), F.expr("substring(run, int(h % length(run)) + 2)"))
        word = F.when(F.col("h") % deletes == 0, cut).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).filter(F.length("word") >= least_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def node_rows(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(node, letter, depth, index of the word) of each word's nodes from the root on, the letter -1 where it ends."""
    sizes = np.array([len(w) for w in words])
    for part in np.split(np.argsort(-sizes, kind="stable"), np.flatnonzero(np.diff(np.cumsum(np.sort(-sizes)) // -TOGETHER)) + 1):
        if not len(part):
            continue
        size = sizes[part]
        text = np.frombuffer("".join(words[i] for i in part).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        first = np.cumsum(size) - size
        h = np.full(len(part), np.uint64(len(NODES)))
        found = []
        for depth in range(int(size[0]) + 1):
            live = int(np.searchsorted(-size, -depth, "right"))  # the longest words come first
            inside = int(np.searchsorted(-size, -depth, "left"))
            letter = np.full(live, -1, np.int32)
            own = text[first[:inside] + depth]
            letter[:inside] = own
            found.append((h[:live].view(np.int64), letter, np.full(live, depth, np.int32), part[:live]))
            h = mixed(h[:inside] ^ ((own + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)))
        yield tuple(np.concatenate(x) for x in zip(*found, strict=True))


def trie_nodes(words: DataFrame) -> DataFrame:
    """``NODES`` of (wid, word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wid = b.column(0).to_numpy()
            for node, letter, depth, at in node_rows(b.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(letter), pa.array(depth), pa.array(wid[at])], names=[c.split()[0] for c in NODES.split(", ")])

    return words.select("wid", "word").mapInArrow(run, NODES)


def light_edges(words: DataFrame) -> DataFrame:
    """(wid, edges): where each word leaves a heavy path, as (depth, heavy), the heavy child's letter; at most log2(words)."""
    children = trie_nodes(words).groupBy("node", "letter").agg(F.count("*").alias("n"))
    heavy = children.groupBy("node").agg(F.count("*").alias("children"), F.max_by("letter", F.struct("n", "letter")).alias("heavy")).filter("children > 1")
    # A table, so that adaptive execution can deal the rows of the uppermost nodes, which all words share, over tasks.
    heavy = stored(heavy.select("node", "heavy"), "heavy")
    light = trie_nodes(words).join(heavy, "node").filter("letter != heavy")
    return light.groupBy("wid").agg(F.collect_list(F.struct("depth", "heavy")).alias("edges"))


def entries(words: DataFrame) -> DataFrame:
    """(word, n, target, open): each word entered again at its light edges.  ``open``: the depth of the letter that is left
    open, null where the entry is a whole word."""
    rows = words.join(light_edges(words), "wid").select("word", "n", F.inline("edges"))
    before, rest = F.expr("left(word, depth)"), F.expr("substring(word, depth + 1)")
    own, after = F.expr("substring(word, depth + 1, 1)"), F.expr("substring(word, depth + 2)")
    # The heavy letter, by its number.
    heavy = F.decode(F.unhex(F.lpad(F.hex("heavy"), 8, "0")), "UTF-32")
    rows = rows.select("word", "n", "depth", before.alias("before"), rest.alias("rest"), own.alias("own"), after.alias("after"), heavy.alias("heavy"))
    inside = F.col("own") != ""
    whole = F.lit(None).cast("int")
    entry = lambda when, target, open_: F.when(when, F.struct(target.alias("target"), open_.alias("open")))
    skipped = F.concat("before", "after")
    made = F.array(
        entry(inside, F.concat("before", "heavy", "after"), whole),
        entry(F.lit(True), F.concat("before", "heavy", "rest"), whole),
        # Where the next letter is the same, the words part further down.
        entry(inside & ~F.startswith("after", "own"), skipped, whole),
        entry(inside, skipped, F.col("depth")),
    )
    return rows.select("word", "n", F.inline(F.filter(made, lambda e: e.isNotNull())))


def partners(words: DataFrame) -> DataFrame:
    """(word, n_near, best): how many words are one edit from a word, and the most frequent of these, the smaller of equal
    ones, as (less, form), ``less`` the negative count.  Partners of a word that are only met through letters left open, and
    rarer than it, count but may be missing as ``best``."""
    entered = stored(entries(words), "entries")
    ranked = lambda n, word: F.struct((-F.col(n)).alias("less"), F.col(word).alias("form"))
    met = entered.filter("open is null").select("word", "n", "target").join(words.select(F.col("word").alias("target"), F.col("n").alias("m")), "target")
    sides = F.array(F.struct("word", ranked("m", "target").alias("best")), F.struct(F.col("target").alias("word"), ranked("n", "word").alias("best")))
    direct = met.select(F.inline(sides)).groupBy("word").agg(F.count("*").alias("near"), F.min("best").alias("best"))
    held = entered.filter("open is not null").select("target", "open", "word", "n")
    groups = held.groupBy("target", "open").agg(F.count("*").alias("size"), F.min(ranked("n", "word")).alias("best")).filter("size > 1")
    shared = held.join(groups, ["target", "open"])
    # A word that is its group's best has only rarer or equal partners there, none of which can be its form.
    best = F.when(F.col("best.form") != F.col("word"), F.col("best"))
    shared = shared.select("word", (F.col("size") - 1).alias("near"), best.alias("best")).groupBy("word").agg(F.sum("near").alias("near"), F.min("best").alias("best"))
    return direct.unionByName(shared).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root): forms (word, form) followed to the last, by doubling."""
    ahead = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = ahead.select(F.col("word").alias("root"), F.col("root").alias("then"))
        joined = stored(ahead.join(further, "root", "left").select("word", F.coalesce("then", "root").alias("root"), F.col("then").isNotNull().alias("moved")), "roots")
        ahead = joined.select("word", "root")
        if joined.filter("moved").isEmpty():
            return ahead


def group_spellings(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the distinct words (word, n)."""
    with scratch(words.sparkSession):
        words = stored(words.select("word", "n").withColumn("wid", F.monotonically_increasing_id()), "words")
        near = words.select("word", "n").join(partners(words), "word", "left")
        fits = -F.col("best.less") >= ratio * F.col("n")
        near = near.select("word", F.when(fits, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, -F.col("best.less")).alias("form_n"))
        near = stored(near, "near", keep=True)
        roots = stored(rooted(near.filter("form is not null")), "roots", keep=True)
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
