"""The ten operators against brute force, round trips and held-out labels; nulls, ties, repeats, empties, clashing names."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marlstone.llm import chat, decontaminate, idstore, near_dups, packing, quality, recompression, suffix_dedup, syncmers, urls, windows
from marlstone.llm.tokens import ChunkEncoder

from . import brute

public = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


def rows(df, n=None):
    return sorted((tuple(r)[:n] for r in df.collect()), key=str)


def same(df, want, n=None):
    assert rows(df, n) == sorted(want, key=str)


# 1, 3, 4


@pytest.mark.parametrize(("size", "most"), [(60, 2048), (60, 3), (9, 4), (2, 2048)])
def test_suffix_dedup(odd_docs, odd_rows, size, most):
    same(suffix_dedup.remove_repeats(odd_docs, min_bytes=size, max_segments=most), brute.suffix_dedup(odd_rows, size))


def test_one_row_of_runs_a_segment(spark):
    """A passage in so many contexts that its keys are split into bands: anchors meet one row of runs each."""
    rng = random.Random(6)
    say = lambda k: "".join(rng.choice("abcdefgh") for _ in range(k))
    passage = say(70)
    own = [(i, say(40) + passage + say(40)) for i in range(60)] + [(7, "one row three times " * 9)] * 3
    texts = windows.texts_of(spark.createDataFrame(own, "doc_id long, text string"), "doc_id", "text")
    anchors = windows.hot_anchors(texts, suffix_dedup.anchor_extract(60))
    segs = windows.segments(anchors)
    body = F.substring(F.col("text").cast("binary"), F.col("at") + 1, F.col("n") + 59).alias("body")
    cols = ["key", "a", "b", "c", "at", "n", "d", "n_segs"]
    rows = windows.open_texts(texts, windows.open_segments(segs), cols).select("text", F.inline("segs")).withColumn("body", body)
    runs = windows.full_runs(segs).unionByName(suffix_dedup.decide(rows, 60, 12, 3))
    assert runs.count() == runs.select("key", "a", "b").distinct().count()
    assert 0 < anchors.join(runs, ["key", "a", "b"]).count() <= anchors.count()
    same(suffix_dedup.remove_repeats(spark.createDataFrame(own, "doc_id long, text string"), min_bytes=60, max_segments=3), brute.suffix_dedup(own, 60))


def test_spans_of_many_copies_of_a_row(spark):
    """The spans of a row are the same however often the row repeats, so the work grows with the rows alone."""
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(470))
    sizes = {}
    for copies in (100, 400):
        own = [(None, text)] * copies + [(1, text[300:900]), (2, "other words " * 9)]
        docs = spark.createDataFrame(own, "doc_id long, text string")
        texts = windows.texts_of(docs, "doc_id", "text")
        for name, op, found in (("bytes", suffix_dedup, suffix_dedup.repeated_spans(texts, 400)), ("words", recompression, recompression.repeated_spans(texts, 35))):
            sizes.setdefault(name, set()).add(found.agg(F.max(F.size("spans"))).first()[0])
        same(suffix_dedup.remove_repeats(docs), brute.suffix_dedup(own, 400))
        same(recompression.remove_repeated_words(docs), brute.word_dedup(own, 35))
    assert all(len(s) == 1 for s in sizes.values())


def test_suffix_array_blocks():
    rng = random.Random(1)
    for _ in range(200):
        w = rng.choice([2, 3, 7])
        parts = ["".join(rng.choice("ab\0") for _ in range(rng.randint(0, 30))).encode() for _ in range(rng.randint(1, 6))]
        count = {}
        for t in parts:
            for i in range(len(t) - w + 1):
                count[t[i : i + w]] = count.get(t[i : i + w], 0) + 1
        for t, got in zip(parts, suffix_dedup.repeated_starts(parts, w), strict=True):
            assert got.tolist() == [count[t[i : i + w]] > 1 for i in range(len(t) - w + 1)]


def test_kept_text(odd_docs, odd_rows):
    got = suffix_dedup.remove_repeats(odd_docs, min_bytes=60, with_text=True).filter("n_removed = 0").collect()
    assert {(r["doc_id"], r["kept"]) for r in got} <= {(d, t or "") for d, t in odd_rows}


@pytest.mark.parametrize("size", [35, 15, 10, 2, 1])
def test_recompression(odd_docs, odd_rows, size):
    same(recompression.remove_repeated_words(odd_docs, window=size), brute.word_dedup(odd_rows, size))


def thue_morse(n):
    """Two words of 2**n letters whose sums of powers agree modulo 2**64 for every odd base."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_words_whose_power_sums_agree(spark):
    x, y = thue_morse(10)
    shared = " ".join(f"w{i}" for i in range(34))
    own = [(1, f"{shared} {x}"), (2, f"{shared} {y}"), (3, f"a b c {x}"), (4, f"a b c {y}"), (5, " ".join(thue_morse(6)[0])), (6, " ".join(thue_morse(6)[1]))]
    docs = spark.createDataFrame(own, "doc_id long, text string")
    same(recompression.remove_repeated_words(docs), brute.word_dedup(own, 35))
    same(near_dups.find_near_dups(docs), brute.near_dups(own), 4)


def test_unit_names_tell_words_apart():
    rng = random.Random(2)
    words = sorted({bytes(rng.choice(b"ab\0\xff") for _ in range(rng.randint(1, 40))) for _ in range(20_000)})
    data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    x, y = windows.unit_names(data, ends - [len(w) for w in words], ends)
    assert len(set(x.tolist())) == len(set(y.tolist())) == len(words)
    again = windows.unit_names(np.frombuffer(b"zz" + words[7] + b"q", np.uint8), np.array([2]), np.array([2 + len(words[7])]))
    assert (again[0][0], again[1][0]) == (x[7], y[7])


@pytest.mark.parametrize(("letters", "w"), [(1, 5), (2, 15), (3, 35), (30, 35), (8, 100)])
def test_windows_share_symbols_whatever_surrounds_them(letters, w, monkeypatch):
    """Equal windows have equal keys at equal places and equal names, runs of any length and block ends included."""
    rng = random.Random(letters)
    for most in (1 << 18, 9):
        monkeypatch.setattr(recompression, "WORDS", most)
        for _ in range(10):
            say = lambda k: [rng.choice("abcdefghijklmnopqrstuvwxyzABCD"[:letters]) for _ in range(k)]
            core, seen = say(w + 20), []
            for _ in range(3):
                before = say(rng.randint(0, 30))
                text = " ".join(before + core + say(rng.randint(0, 30)))
                _, _, x, y = recompression.words_of(np.frombuffer(text.encode(), np.uint8), np.array([len(text)]))
                at = len(before) + np.arange(21)
                parse = recompression.parsed(x, None, np.array([len(x)]), 0, len(x), w)
                place = parse.anchors(w)[at]
                key = np.where(place < 0, parse.run_keys(np.minimum(place, -1)), parse.keys(np.maximum(place, 0)))
                far = np.where(place < 0, 0, parse.starts[np.maximum(place, 0)] - at)
                names = recompression.window_names(x, y, at, w)
                seen.append((key.tolist(), far.tolist(), names.tolist()))
                words = text.split()
                every = recompression.window_names(x, y, np.arange(len(words) - w + 1), w)
                assert len({tuple(r) for r in every.tolist()}) == len({tuple(words[i : i + w]) for i in range(len(words) - w + 1)})
            assert seen[0] == seen[1] == seen[2]


def test_levels_shrink_texts():
    words = np.random.default_rng(1).integers(0, 1 << 62, 20_000, dtype=np.uint64)
    sizes = [len(x) for x in recompression.Parse(words, None, np.zeros(len(words), bool), 6).names]
    assert all(b < 0.8 * a for a, b in zip(sizes, sizes[1:]))
    assert [len(x) for x in recompression.Parse(words[:1].repeat(5000), None, np.zeros(5000, bool), 1).names] == [5000, 1]


@pytest.mark.parametrize(("group", "region"), [(2_000_000, 2048), (300, 64), (2_000_000, 2)])
def test_near_dups(odd_docs, odd_rows, group, region):
    same(near_dups.find_near_dups(odd_docs, group_shingles=group, region=region), brute.near_dups(odd_rows), 4)


def test_regions_of_sorted_orders(spark):
    """Regions and their depth against grouping by prefixes, on orders spread over several tasks."""
    rng = random.Random(3)
    rows = [(bytes(2 * rng.choice(x) // 2 for _ in range(9) for x in ((0,), range(2))), i) for i in range(400)]
    depth, most = 2, 20
    found = near_dups.regions(spark.createDataFrame([(bytearray(s), i) for s, i in rows], "seq binary, cid long"), depth, most).collect()
    unit = {i: tuple(s[j : j + 2] for j in range(0, 18, 2)) for s, i in rows}
    base = Counter(unit[i][: 1 + depth] for i in unit)
    by_region, by_first = {}, {}
    for r in found:
        by_region.setdefault(r["region"], set()).add(r["cid"])
        by_first.setdefault((r["region"], r["first"]), []).append(r["cid"])
    assert {frozenset(x) for x in by_region.values() if len(x) > 1} == {frozenset(i for i in unit if unit[i][: 1 + depth] == p) for p in base if base[p] > 1}
    for (_, first), own in by_first.items():
        assert all(unit[i][: 1 + depth] == unit[first][: 1 + depth] for i in own)
    assert any(r["deeper"] for r in found)


def test_forest_finds_links_against_all_pairs(spark):
    """Documents of one shared passage, none alike, with a few near pairs among them: regions are read deeper, the next
    forests and the blocks in the end find the pairs."""
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(60)]
    own = []
    for i in range(120):
        mine = [f"u{i}x{j}" for j in range(60)]
        own.append((i, " ".join(passage + mine)))
        if i % 10 == 0:
            mine[rng.randrange(60)] = "other"
            own.append((1000 + i, " ".join(passage + mine)))
    want = brute.near_dups(own)
    assert sum(not r[3] for r in want) == 12
    docs = spark.createDataFrame(own, "doc_id long, text string")
    for region, group in ((2048, 2_000_000), (3, 2000), (3, 600)):
        same(near_dups.find_near_dups(docs, region=region, group_shingles=group), want, 4)


def test_near_dups_of_one_large_group(spark):
    """Near copies around one original: few are near each other, all are near the original."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    own = [(0, " ".join(base))]
    for i in range(1, 160):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(150)] = f"x{rng.random()}"
        own.append((i, " ".join(w)))
    docs = spark.createDataFrame(own, "doc_id long, text string")
    same(near_dups.find_near_dups(docs, group_shingles=1500), brute.near_dups(own), 4)


# 2


def test_fingerprints(spark, odd_rows):
    own = [(d, t) for d, t in {d: t for d, t in odd_rows if d is not None}.items()]
    found = syncmers.fingerprint_edits(spark.createDataFrame(own, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found) == sorted(brute.fingerprint_texts(own))
    by_text = {}
    for r in found:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert by_text.setdefault(dict(own)[r["doc_id"]] or "", r["fingerprint"]) == r["fingerprint"]


def test_fingerprint_anchors_are_closed_syncmers(spark):
    text = " ".join(f"w{i % 37}" for i in range(400))
    row = syncmers.fingerprint(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    pairs = spark.range(399).select(F.xxhash64(F.xxhash64(F.concat(F.lit("w"), F.col("id") % 37)), F.xxhash64(F.concat(F.lit("w"), (F.col("id") + 1) % 37)))).collect()
    s = [r[0] for r in pairs]
    assert [a["position"] for a in row["anchors"]] == [i for i in range(397) if min(s[i], s[i + 2]) <= s[i + 1]]


def parts_of(anchors):
    links = [(a["hash"], b["hash"], b["position"] - a["position"]) for a, b in zip(anchors, anchors[1:])]
    return Counter([a["hash"] for a in anchors] + links)


def test_likeness_is_of_all_anchors(spark, odd_rows):
    """Long texts with a small common passage, a one-word edit of a long text, the odd texts: against counts of all parts."""
    rng = random.Random(3)
    say = lambda k: " ".join(f"w{rng.randrange(10**9)}" for _ in range(k))
    shared, long = say(60), say(4000).split()
    changed = [*long[:2000], "other", *long[2001:]]
    own = [(9, say(3000) + " " + shared + " " + say(3000)), (8, say(5000) + " " + shared), (7, " ".join(long)), (6, " ".join(changed)), (5, "a b c d e f " * 30), (4, "a b c d e f " * 60)]
    own += [(100 + d, t) for d, t in {d: t for d, t in odd_rows if d is not None}.items()]
    docs = spark.createDataFrame(own, "doc_id long, text string")
    anchors = {r["doc_id"]: r["anchors"] for r in syncmers.fingerprint(docs).collect()}
    found = {r["doc_id"]: r for r in syncmers.fingerprint_edits(docs).collect()}
    order = sorted(anchors, reverse=True)
    for d, n in zip(order, order[1:] + order[:1]):
        a, b = parts_of(anchors[d]), parts_of(anchors[n])
        want = (a & b).total() / (a | b).total() if a or b else 1
        assert abs(found[d]["near_next"] - want) < 1e-12, d
    assert 0.003 < found[9]["near_next"] < 0.02 and 0.99 < found[7]["near_next"] < 1 and found[5]["near_next"] < 0.6
    assert found[7]["fingerprint"] != found[6]["fingerprint"]
    for r in found.values():
        places = [(i, x) for i, x in enumerate(r["fingerprint"].split(",")) if x]
        assert places == [(a["position"], f"{a['hash'] & (1 << 64) - 1:x}") for a in anchors[r["doc_id"]]]


def test_every_text_with_words_has_an_anchor(spark):
    own = [(i, f"w{i} x{i} y{i} z{i}") for i in range(60)] + [(60, " \n\t"), (61, "q" * 80)]
    found = {r["doc_id"]: r for r in syncmers.fingerprint(spark.createDataFrame(own, "doc_id long, text string")).collect()}
    assert found[60]["fingerprint"] == "" and all(found[i]["anchors"] for i in found if i != 60)
    assert len({found[i]["fingerprint"] for i in range(60)}) == 60
    edits = syncmers.fingerprint_edits(spark.createDataFrame(own, "doc_id long, text string")).collect()
    assert all(r["near_next"] == 0 for r in edits)


def test_long_runs_keep_anchors_after_an_insertion(spark):
    rng = random.Random(8)
    for letters in ("".join(map(chr, range(0x4E00, 0x5200))), "ABCDabcd0123+/"):
        run = "".join(rng.choice(letters) for _ in range(600))
        docs = spark.createDataFrame([(1, run[:5] + "x" + run[5:]), (2, run)], "doc_id long, text string")
        assert all(0.9 < r["near_next"] < 1 for r in syncmers.fingerprint_edits(docs).collect())
    words = spark.createDataFrame([("ab " + "c" * 24 + "\n" + "0123456789" * 2 + "abcde \U0001f600\u00e9",)], "t string")
    got = syncmers.hashed(words, "t").first()
    long = "0123456789" * 2 + "abcde"
    want = spark.createDataFrame([(w,) for w in ["ab", "c" * 24, *(long[i : i + 8] for i in range(25)), "\U0001f600\u00e9"]], "w string")
    assert got["words"] == [r[0] for r in want.select(F.xxhash64("w")).collect()] and got["sizes"] == [1, 1, 25, 1]


def test_edited_texts_have_the_anchors_of_their_whole(spark, monkeypatch):
    """Anchors cut and joined are those of the edited text read as a whole, wherever the cuts fall."""
    monkeypatch.setattr(syncmers, "BUCKET_DOCS", 50)
    rng = random.Random(9)
    pieces = ["ab", "c", " ", "  ", "\n", "\x0b", "é" * 30, "q" * 24, "w" * 25, " xyz", " one two three four five six "]
    own = {i: "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for i in range(800)}
    found = {r["doc_id"]: r for r in syncmers.fingerprint_edits(spark.createDataFrame(list(own.items()), "doc_id long, text string")).collect()}
    order = sorted(own, reverse=True)
    edited = {}
    for d, n in zip(order, order[1:] + order[:1]):
        k = len(own[d]) // 2
        edited[d] = own[d][: len(own[d]) - k] + own[n][:k]
    whole = {r["doc_id"]: r for r in syncmers.fingerprint(spark.createDataFrame(list(edited.items()), "doc_id long, text string")).collect()}
    first = {r["doc_id"]: r for r in syncmers.fingerprint(spark.createDataFrame(list(own.items()), "doc_id long, text string")).collect()}
    for d in order:
        assert (found[d]["fingerprint"], found[d]["edited_fingerprint"]) == (first[d]["fingerprint"], whole[d]["fingerprint"])
        a, b = parts_of(first[d]["anchors"]), parts_of(whole[d]["anchors"])
        assert abs(found[d]["near_edited"] - ((a & b).total() / (a | b).total() if a or b else 1)) < 1e-12


def test_fingerprints_of_buckets_and_ties(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "BUCKET_DOCS", 7)
    own = [(i * 3, f"text number {i} with some words") for i in range(60)]
    found = syncmers.fingerprint_edits(spark.createDataFrame(own, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found) == sorted(brute.fingerprint_texts(own))


def test_fingerprints_of_one_id(spark, monkeypatch):
    """Most rows have one id, in buckets cut by their texts' hashes, and many are equal."""
    monkeypatch.setattr(syncmers, "BUCKET_DOCS", 7)
    own = [(5, f"text number {i % 40} with some words") for i in range(120)] + [(i, f"other text {i} of words") for i in (1, 2, 9)] + [(None, f"nameless {i}") for i in range(30)]
    texts = spark.createDataFrame(own, "doc_id long, text string")
    hashed = {r[1]: r[2] for r in texts.selectExpr("doc_id", "text", "xxhash64(text)").collect()}
    order = sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1]]), reverse=True)
    want = []
    for (d, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        k = len(t) // 2
        want.append((d, len(t), brute.sha(t[: len(t) - k] + n[:k])))
    found = syncmers.fingerprint_edits(texts).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found), key=str) == sorted(want, key=str)


def test_buckets_by_binary_search(spark):
    rng = random.Random(1)
    cuts = sorted({(rng.randrange(20) - 10, rng.randrange(10) - 5) for _ in range(60)})
    rows = [(a, b) for a in range(-12, 13) for b in range(-6, 7)]
    for some in (cuts, cuts[:1], cuts[:2], []):
        got = spark.createDataFrame(rows, "rid long, rhash long").withColumn("b", syncmers.bucket_of(some)).collect()
        assert all(r["b"] == sum(c < (r["rid"], r["rhash"]) for c in some) for r in got)


def test_fingerprints_are_native(spark):
    plan = syncmers.fingerprint_edits(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_fingerprints_of_odd_rows(odd_docs, odd_rows, no_docs):
    assert syncmers.fingerprint_edits(odd_docs).count() == len(odd_rows)
    assert syncmers.fingerprint_edits(no_docs).count() == 0


# 5, 7


ODD = ["", " ", "  a", "a  b", "a \n b", "a\n b", "a\n  b ", " lead", "tail ", "don't stop 's x", "ÀÉ Σας ΣΑΣ İstanbul", "<|endoftext|> x", "é\u0301x y", "x.. y,. z, 12 34.", "日本 語. ok", "a\tb c\t d", "\n\nfoo bar\n", "a.\nb c\nd e.\n\nf g\n h \ni", "x\u00a0\ny z\n\u00a0w q.\nr", "ab.cd.\nX. É.\nÉa"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunk_encoder(spark, name):
    enc = ChunkEncoder(public.path(name))
    own = ODD + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for t in own + own:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == encoded(name, t, 0)[:-1], t[:80] if t else t


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunk_encoder_on_random_strings(name):
    rng, enc = random.Random(11), ChunkEncoder(public.path(name))
    bits = ["a", "the", "B", " ", " ", "  ", "\n", "\t", "é", "İ", "ſ", "\u0301", "'s", "n't", ".", ",", "12", "日本", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "_", "-", "\u00a0", "\0", "ΑΣ"]
    for _ in range(20_000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == encoded(name, t, 0)[:-1], repr(t)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunk_encoder_on_added_tokens(name):
    enc, plain = ChunkEncoder(public.path(name)), Tokenizer.from_file(public.path(name))
    own = ["foo <|endoftext|> bar", "<|endoftext|>", "a b<|endoftext|>c d", "x <|startoftext|> y", "<|ENDOFTEXT|> <|endof text|>", "a <|endoftext|><|endoftext|>\n b", "no token of that kind, < | endoftext|>"]
    for t in own + own + ODD:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t


_plain = {}


def encoded(name, text, end):
    """The ids by a tokenizer of its own, loaded as any user would."""
    if name not in _plain:
        _plain[name] = Tokenizer.from_file(public.path(name))
    return _plain[name].encode(text or "", add_special_tokens=False).ids + [end]


def test_packing(odd_docs, odd_rows):
    found = packing.pack_documents(odd_docs, public.path("byte_bpe_50k.json"), with_ids=True).collect()
    by_doc, by_seq = {}, {}
    for r in found:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0 and zlib.crc32(r["ids"]) == r["ids_crc32"]
        by_doc.setdefault(r["doc_id"], []).append((r["start"], ids, r["doc_tokens"]))
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024 and at & (at - 1) == 0  # no padding anywhere
    for d, t in odd_rows:
        if d is None or d in (3, 4):  # ids of several rows
            continue
        ids = [i for _, part, _ in sorted(by_doc[d]) for i in part]
        assert ids == encoded("byte_bpe_50k.json", t, 0) and len(ids) == by_doc[d][0][2]
    assert len(by_doc[None]) >= 2


def test_tiers_and_step_groups(spark):
    """Every sequence fills its tier; the step groups of a tier hold equal token counts, but one a task."""
    rng = random.Random(2)
    own = [(i, " ".join(rng.choice(["alpha", "beta", "x"]) for _ in range(rng.choice([3, 40, 300, 1500])))) for i in range(400)]
    docs = spark.createDataFrame(own, "doc_id long, text string").repartition(2)
    found = packing.pack_documents(docs, public.path("byte_bpe_50k.json"), step_tokens=2048).collect()
    seqs, groups = {}, {}
    for r in found:
        key = (r["sequence_id"], r["tier"], r["step_group"])
        seqs[key] = seqs.get(key, 0) + r["length"]
    assert len({k[0] for k in seqs}) == len(seqs) and all(n == tier for (_, tier, _), n in seqs.items())
    for (_, tier, group), n in seqs.items():
        groups.setdefault((tier, group >> 40), {}).setdefault(group, []).append(n)
    for (tier, _), own in groups.items():
        assert sorted(sum(x) for x in own.values())[1:] == [max(2048, tier)] * (len(own) - 1)
    assert len({k[1] for k in seqs}) > 3


def test_gaps_are_filled_best_fit():
    out = []
    packer = packing.Packer((4, 8), lambda tier, parts: out.append((tier, [p[2] for p in parts])))
    for i, n in enumerate((6, 5, 2, 2, 1)):
        packer.add(n, i, 0)
    packer.pack(last=True)
    assert out == [(8, [6, 2]), (8, [5, 2, 1])]
    packer.add(7, "a", 0)
    packer.add(6, "b", 0)
    packer.pack(last=True)
    # Nothing fits a gap of one: a piece is cut; the rest goes to powers of two.
    assert out[2:] == [(8, [7, 1]), (4, [4]), (1, [1])]


def test_token_store(spark, odd_docs, odd_rows):
    path = idstore.write_store(odd_docs, public.path("word_bpe_49k.json"), 2)
    found = sorted((tuple(r) for r in idstore.scan_store(spark, path).collect()), key=lambda r: r[1])
    assert len(found) == len(odd_rows)
    at = 0
    hashed = {r[0]: r[1] for r in spark.createDataFrame([(t or "",) for _, t in odd_rows], "t string").selectExpr("t", "xxhash64(t)").collect()}
    want = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1] or ""]))
    for (d, start, n, crc), (key, text) in zip(found, want, strict=True):
        ids = encoded("word_bpe_49k.json", text, 2)
        assert (d, start, n, crc) == (key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += n
    got = idstore.lookup(spark, path, [4, 7, 1006, 55555]).collect()
    assert sorted(r["doc_id"] for r in got) == [4, 4, 7, 1006]
    assert [r["ids"] for r in got if r["doc_id"] == 7] == [encoded("word_bpe_49k.json", dict(odd_rows)[7], 2)]


@pytest.mark.parametrize("n", [0, 1, 2, 255, 257, 20_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(1).integers(-(1 << 63), 1 << 63, n))
    slots = idstore.PerfectHash(*idstore.PerfectHash.build(keys)).slots(keys)
    assert sorted(slots) == list(range(len(keys)))


def test_token_store_of_one_key(spark, monkeypatch):
    """Most rows have one id, or none: shards end inside a key, and tasks share it."""
    monkeypatch.setattr(idstore, "SHARD_DOCS", 64)
    texts = [(7, f"text {i % 900}") for i in range(3000)] + [(None, f"null {i % 50}") for i in range(1000)] + [(i, f"own {i}") for i in range(20)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    path = idstore.write_store(docs, public.path("word_bpe_49k.json"), 2)
    store = idstore.read_store(spark, path)
    assert store.agg(F.max("n_docs")).first()[0] <= 64 and store.filter("first_key <= 7 and last_key >= 7").count() > 40
    found = idstore.scan_store(spark, path).orderBy("start").collect()
    assert len(found) == len(texts) and found[0]["start"] == 0
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(found, found[1:]))
    assert [r["doc_id"] for r in found] == sorted((d for d, _ in texts), key=lambda d: (d is not None, d or 0))
    got = Counter(tuple(r["ids"]) for r in idstore.lookup(spark, path, [7, 9]).collect())
    assert got == Counter(tuple(encoded("word_bpe_49k.json", t, 2)) for d, t in texts if d in (7, 9))


def test_write_tasks_grow(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert idstore.write_tasks(docs) == 4 == idstore.write_tasks(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    monkeypatch.setattr(idstore, "TASK_BYTES", 10_000)
    assert idstore.write_tasks(docs) > 4


# 6


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scores = quality.score_documents(spark.read.parquet(f"{sf}/documents.parquet"), labels, learn_from=~held)
    found = scores.join(labels, "doc_id").filter(held).select("score", "quality").toPandas()
    good, bad = (found[found.quality == q].score.values[:, None] for q in (1, 0))
    assert ((good > bad.T) + 0.5 * (good == bad.T)).mean() > 0.97


def test_quality_of_odd_rows(spark, odd_docs, odd_rows, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(None, 1), (5, None), (6, 7), (1000, 0)], "doc_id long, quality int")
    found = quality.score_documents(odd_docs, labels).collect()
    assert len(found) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in found)
    only = quality.score_documents(odd_docs, labels.filter("quality = 1")).collect()
    assert all(r["score"] == 1 for r in only)
    assert all(r["score"] == 0.5 for r in quality.score_documents(odd_docs, labels.limit(0)).collect())
    assert quality.score_documents(no_docs, labels).count() == 0


def test_isotonic():
    rates = quality.pooled(np.array([1, 1, 1, 1.0]), np.array([0, 1, 0, 1.0]))
    assert rates.tolist() == [0, 0.5, 0.5, 1]


# 8


def test_chat_round_trip(spark):
    said = [(1, 0, "user", "a <|im_end|> \\ <\\|x| <\\\\|"), (1, 1, "assistant", "ok\n<|im_start|>user"), (2, 0, "ro\nle\\n<|x", None), (2, 0, None, "tie"), (2, 0, None, "tie"), (None, 5, "assistant", ""), (3, 1, "assistant", "é" * 5000)]
    df = spark.createDataFrame([(*r, "x") for r in said], "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_conversations(df)
    found = {r["conv_id"]: r for r in chat.read_back(out).collect()}
    for conv in {r[0] for r in said}:
        turns = sorted(((t, r or "", x or "") for c, t, r, x in said if c == conv), key=lambda r: (r[0], chat.escape_line(r[1]) + "\n" + chat.escape(r[2])))
        mine = [x for _, r, x in turns if r == "assistant"]
        r = found[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), brute.sha("".join(f"{a}\n{b}\n" for _, a, b in turns)))
        assert (r["loss_chars"], r["loss_sha256"]) == (sum(map(len, mine)), brute.sha("".join(mine)))
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_escapes_are_reversible():
    rng = random.Random(4)
    for _ in range(2000):
        t = "".join(rng.choice("<|\\\nna") for _ in range(rng.randint(0, 12)))
        assert chat.unescape(chat.escape(t)) == t == chat.unescape_line(chat.escape_line(t))
        assert "<|" not in chat.escape(t) and "\n" not in chat.escape_line(t)


def test_templates():
    t = chat.Template("{% for m in messages %}{% if m.role == 'user' and not false %}U{{ 'a' + 'b' | upper }}{% elif m.role != 'x' %}{% generation %}{{ m.text | trim }}{% endgeneration %}{% else %}-{% endif %}{% endfor %}")
    assert t.render([{"role": "user", "text": "q"}, {"role": "assistant", "text": " hi "}, {"role": "x", "text": ""}]) == ("UaBhi-", [(3, 5)])
    assert chat.fold(chat.parse("{% if 'a' == 'a' %}x{{ 'y' | upper }}{% else %}n{% endif %}z")).parts == [chat.Node("text", "xYz")]
    for bad in ("{{ m.__class__ }}", "{{ open('x') }}", "{% import os %}", "{% for m in x %}{% endfor %}", "{{ 'a' | eval }}", "{% if 1 %}", "{{ a[0] }}"):
        with pytest.raises(chat.TemplateError):
            chat.Template(bad)


# 9, 10


def test_decontamination(spark, odd_docs, odd_rows, monkeypatch):
    words = re.findall(brute.ALNUM, brute.lower(dict(odd_rows)[1006]))[:40]
    items = [(1, " ".join(words)), (2, "one, TWO!"), (3, None), (4, "..."), (5, odd_rows[10][1]), (6, "x " * 20), (5, odd_rows[10][1]), (10, odd_rows[11][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contamination(odd_rows, items)
    assert any(x[5] for x in want) and not all(x[5] for x in want)
    same(decontaminate.find_contamination(odd_docs, bench), want, 6)
    clean = [d for d, t in odd_rows if not dict(zip(odd_rows, want, strict=True))[d, t][5]]
    assert sorted(map(str, (r["doc_id"] for r in decontaminate.without_contaminated(odd_docs, bench).collect()))) == sorted(map(str, clean))
    # A benchmark that takes several automata, of items in several parts.
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 200)
    monkeypatch.setattr(decontaminate, "PART_WORDS", 5)
    assert decontaminate.parts_table(bench, "item_id", ("text",), 13)[1] > 3
    same(decontaminate.find_contamination(odd_docs, bench), want, 6)
    assert sorted(map(str, (r["doc_id"] for r in decontaminate.without_contaminated(odd_docs, bench).collect()))) == sorted(map(str, clean))
    assert decontaminate.find_contamination(odd_docs, bench.limit(0)).filter("contaminated").count() == 0


def test_scans_against_brute_force():
    """Few words, so that windows overlap, repeat and touch; windows of several sizes, items shorter, as long and longer."""
    rng = random.Random(7)
    say = lambda k: " ".join(rng.choice(["a", "b", "ab", "C"]) for _ in range(k))
    for size in (1, 2, 3, 6, 13):
        for _ in range(40):
            items = [(i, say(rng.randint(0, 2 * size + 3))) for i in range(rng.randint(0, 5))]
            docs = [(i, say(rng.randint(0, 40))) for i in range(5)] + [(9, items[0][1] if items else "")]
            scan = decontaminate.Scanner(items, size).scan
            got = [(n, int(h.sum()), len(s), brute.sha(",".join(sorted(s)))) for n, h, s in (scan(t) for _, t in docs)]
            assert got == [w[1:5] for w in brute.contamination(docs, items, size)]


def test_automaton_stays_small():
    """A word of the benchmark lies in one pattern: the automaton of 300,000 characters takes far under 50 MB."""
    rng = random.Random(5)
    items = [(i, " ".join(f"w{rng.randrange(50_000)}" for _ in range(500))) for i in range(100)]
    scan = decontaminate.Scanner(items)
    size = sum(len(t) for _, t in items)
    assert scan.automaton.get_stats()["total_size"] < 60 * size


def test_hits_map_to_the_original():
    scan = decontaminate.Scanner([(1, "zwei Drei")])
    for text, want in (("Éins ZWEI, (drei)! und zwei", ["ZWEI, (drei"]), ("ZWEI, \u00a0 drei; zwei -- drei", ["zwei -- drei"]), ("", [])):
        assert [text[a:b] for a, b in scan.spans(text)] == want


def test_urls(spark):
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "a.net", "/f")]
    cases = {"http://WWW.example.com/en/x": ("www.example.com", "/en/x", "www.example.com/en/", "allow"), "https://m.example.com/en/?q": ("m.example.com", "/en/", "example.com/en/", "block"), "x://example.com/en#f": ("example.com", "/en", "com/", "allow"),
             "x://net/es/": ("net", "/es/", "net/es/", "block"), "x://b.a.net/foo/b": ("b.a.net", "/foo/b", "a.net/f", "block"), "x://notexample.net/": ("notexample.net", "/", None, "allow"), "x://a.com": ("a.com", "", None, "allow"), "nothing": ("", "", None, "allow"), None: ("", "", None, "allow"), "x://a.com?u=://b/es/": ("a.com", "", None, "allow"), "x://É.COM/": ("É.com", "/", "com/", "allow")}
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(cases)], "page_id long, url string, host string")
    same(urls.judge_urls(df, rules), [(i, *w) for i, w in enumerate(cases.values())])
    with pytest.raises(ValueError):
        urls.Trie([("allow", "com", "en")])


# all


def test_urls_of_odd_rows(spark):
    rows = [(1, "x://a.com/"), (1, "x://a.com/"), (None, None), (None, "x://b.net/es/1"), (2, "")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    want = [(1, "a.com", "/", "com/", "allow")] * 2 + [(None, "", "", None, "allow"), (None, "b.net", "/es/1", "net/es/", "block"), (2, "", "", None, "allow")]
    same(urls.judge_urls(df, [("allow", "com", "/"), ("block", "net", "/es/")]), want)
    assert urls.judge_urls(df.limit(0), []).count() == 0


def test_likeness_of_empty_texts(spark):
    docs = spark.createDataFrame([(3, "some words of a text here"), (2, None), (1, " ")], "doc_id long, text string")
    found = {r["doc_id"]: (r["near_edited"], r["near_next"]) for r in syncmers.fingerprint_edits(docs).collect()}
    assert found[3][1] == 0 and found[2] == (1, 1) and found[1][1] == 0


def test_texts_longer_than_a_block(spark, monkeypatch):
    """One text of several blocks among short ones, and many rows of one id, of none, and equal rows."""
    rng = random.Random(21)
    say = lambda k: " ".join(rng.choice(["ab", "cd", "efg", "h"]) + str(rng.randrange(30)) for _ in range(k))
    long, passage = say(1500), say(45)
    own = [(1, long + " " + passage + " " + say(700)), (2, say(20) + " " + passage), (3, long[2000:5000])]
    own += [(9, f"{say(30)} {passage if i % 3 else ''}") for i in range(25)] + [(9, "equal rows of one id " * 12)] * 25 + [(None, say(40) + passage) for _ in range(10)]
    docs = spark.createDataFrame(own, "doc_id long, text string")
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1500)
    same(suffix_dedup.remove_repeats(docs, min_bytes=60), brute.suffix_dedup(own, 60))
    monkeypatch.setattr(recompression, "BLOCK", 1500)
    monkeypatch.setattr(recompression, "WORDS", 200)
    same(recompression.remove_repeated_words(docs), brute.word_dedup(own, 35))
    same(near_dups.find_near_dups(docs), brute.near_dups(own), 4)
    monkeypatch.setattr(quality, "BLOCK", 1500)
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality int")
    assert quality.score_documents(docs, labels).count() == len(own)
    items = [(7, passage), (8, long[3000:3400])]
    same(decontaminate.find_contamination(docs, spark.createDataFrame(items, "item_id long, text string")), brute.contamination(own, items), 6)


def test_empty_tables(spark, no_docs):
    assert suffix_dedup.remove_repeats(no_docs).count() == 0
    assert recompression.remove_repeated_words(no_docs).count() == 0
    assert near_dups.find_near_dups(no_docs).count() == 0
    assert packing.pack_documents(no_docs, public.path("byte_bpe_50k.json")).count() == 0
    assert idstore.scan_store(spark, idstore.write_store(no_docs, public.path("word_bpe_49k.json"), 2)).count() == 0
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.find_contamination(no_docs, bench).count() == 0
