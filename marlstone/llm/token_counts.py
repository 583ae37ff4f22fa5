"""Operator 11: token counts at every prefix.

``counts[p]`` is the number of tokens of a text's first ``p`` characters, as the tokenizer itself would count them, for
every ``p``: so how much of a text fits a budget, and what a cut text costs, is read off without encoding again.

The file is a BPE one with word ends.  Inside a pre-token, a prefix's encoding is an earlier prefix's with one token more,
so a table over prefixes suffices: the last token of the first ``i`` bytes is the one vocabulary entry that ends there and
doesn't merge with the last token of the bytes before it.  Two tokens stay apart if no merge joins a piece at the end of
the left one with a piece at the start of the right one while both exist.  As a cut pre-token takes the word end at its
cut, a second look at each prefix asks for the one entry with a word end that fits there.  A step is a few look-ups, and
can be taken back, which characters that compose with the one before need.

Counts of a text between two blanks don't depend on what is around it; a worker keeps the steps of such chunks.  Words of
Latin letters take their steps together, a block of words at a time (:class:`WordTable`); all else takes them one by one.

Edge cases: a null text is empty, and has no tokens; null and repeated ids are rows like any others; the strings of special
tokens in a text are one token each where they are whole, ordinary text where a prefix cuts them; texts of any length
take time in proportion; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Tokens over which a text is reported.
LIMIT = 2048
#: Chunks kept by one counter, in two generations of half as many, and the longest that are kept.
CACHE_ENTRIES, CACHE_CHARS = 600_000, 64
#: Symbols after a word, which are a pre-token of their own there.
SYMBOLS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
#: Fixed values of the file's format: endings that are a pre-token after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
LETTER, NUMBER, SPACE, OTHER = range(4)


class Vocabulary:
    """Tokens of a BPE file, how they were merged, and which may stand side by side."""

    def __init__(self, model: dict):
        self.end = model["end_of_word_suffix"]
        self.parts: dict[str, tuple[str, str]] = {}
        self.rank: dict[tuple[str, str], int] = {}
        for i, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[a, b] = i
            self.parts.setdefault(a + b, (a, b))
        self.inner: dict = {}
        self.final: dict = {}
        for token in model["vocab"]:
            ends = token.endswith(self.end) and token != self.end
            body = token[: -len(self.end)] if ends else token
            if body and self.sound(token, body, ends):
                node = self.final if ends else self.inner
                for ch in reversed(body):
                    node = node.setdefault(ch, {})
                node[""] = token
        self.known: dict[tuple[str, str], bool] = {}

    def sound(self, token: str, body: str, ends: bool) -> bool:
        """Whether a token is its own encoding: each of its halves is, and they meet at its merge."""
        if len(body) == 1:
            return True
        if token not in self.parts:
            return False
        a, b = self.parts[token]
        return self.first_meeting(a, b) == self.rank[a, b]

    def spine(self, token: str, side: int) -> list[tuple[str, float]]:
        """The pieces at a token's end (side 1) or start (0), each with the rank of the merge that takes it up."""
        out, taken = [], float("inf")
        while True:
            out.append((token, taken))
            pair = self.parts.get(token)
            if not pair:
                return out
            taken, token = self.rank[pair], pair[side]

    def first_meeting(self, a: str, b: str) -> float:
        """The rank of the first merge across the border of two tokens; infinite if there is none."""
        best = float("inf")
        right = self.spine(b, 0)
        for x, x_taken in self.spine(a, 1):
            for y, y_taken in right:
                # Of equal pairs the left one merges first: it takes x from here, but not y.
                r = self.rank.get((x, y))
                if r is not None and r < x_taken and r <= y_taken and r < best:
                    best = r
        return best

    def apart(self, a: str, b: str) -> bool:
        found = self.known.get((a, b))
        if found is None:
            if len(self.known) > 2_000_000:
                self.known.clear()
            found = self.known[a, b] = self.first_meeting(a, b) == float("inf")
        return found


#: Words that take their steps together: Latin-1 letters, whose lower case is one such letter, of up to so many characters.
WORD = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]{1,48}")
#: Words of a block, characters of texts that are counted together, and places for known pairs of tokens.
BLOCK, TOGETHER, PAIRS = 1 << 15, 1 << 22, 1 << 21


class WordTable:
    """The table over prefixes for many words at once: a column for each prefix, numbers for tokens."""

    def __init__(self, vocab: Vocabulary, alphabet: list[str]):
        #: Bytes of Latin-1 letters in lower case, numbered.
        letters = sorted({b for c in range(0x61, 0x100) if WORD.fullmatch(chr(c)) for b in chr(c).lower().encode()})
        self.number = np.zeros(256, np.int16)
        self.number[letters] = np.arange(len(letters))
        names = list(dict.fromkeys([*vocab.parts, *(x for pair in vocab.parts.values() for x in pair), *(a + e for a in alphabet for e in ("", vocab.end))]))
        ids = {x: i for i, x in enumerate(names)}
        symbols = {alphabet[b]: i for i, b in enumerate(letters)}
        self.inner, self.inner_token = self.dense(vocab.inner, symbols, ids)
        self.final, self.final_token = self.dense(vocab.final, symbols, ids)
        self.ends, self.starts = (self.spines(vocab, names, ids, side) for side in (1, 0))
        pairs = np.array([(ids[a] << 20) | ids[b] for a, b in vocab.rank], np.int64)
        self.merges = np.sort(pairs)
        self.ranks = np.fromiter(vocab.rank.values(), np.int64)[np.argsort(pairs)]
        #: Known pairs: the pair's number twice, plus one if it stays apart; a pair has one place.
        self.pairs = np.full(PAIRS, -1, np.int64)

    @staticmethod
    def dense(tree: dict, symbols: dict[str, int], ids: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """A tree as a matrix of followers (-1: none), and each node's token."""
        nodes, edges, token = [tree], [], []
        for i, node in enumerate(nodes):  # grows as it is read
            token.append(ids[node[""]] if "" in node else -1)
            for ch, child in node.items():
                if ch in symbols:
                    edges.append((i, symbols[ch], len(nodes)))
                    nodes.append(child)
        follow = np.full((len(nodes), len(symbols)), -1, np.int32)
        i, s, j = np.array(edges).T
        follow[i, s] = j
        return follow, np.array(token, np.int32)

    @staticmethod
    def spines(vocab: Vocabulary, names: list[str], ids: dict[str, int], side: int) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`Vocabulary.spine` of every token: numbers (-1 past its end) and ranks."""
        found = [vocab.spine(x, side) for x in names]
        depth = max(map(len, found))
        piece, taken = np.full((len(names), depth), -1, np.int32), np.zeros((len(names), depth), np.int64)
        for i, f in enumerate(found):
            piece[i, : len(f)] = [ids[x] for x, _ in f]
            taken[i, : len(f)] = [min(t, 1 << 40) for _, t in f]
        return piece, taken

    def meets(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether some merge crosses the border of the tokens ``a`` and ``b``."""
        out = np.zeros(len(a), bool)
        (x, x_taken), (y, y_taken) = self.ends, self.starts
        for i in range(x.shape[1]):
            live = np.flatnonzero(x[a, i] >= 0)
            if not len(live):
                break
            for j in range(y.shape[1]):
                live = live[(y[b[live], j] >= 0) & ~out[live]]
                if not len(live):
                    break
                left, right = a[live], b[live]
                key = (x[left, i].astype(np.int64) << 20) | y[right, j]
                at = np.minimum(np.searchsorted(self.merges, key), len(self.merges) - 1)
                rank = self.ranks[at]
                out[live] = (self.merges[at] == key) & (rank < x_taken[left, i]) & (rank <= y_taken[right, j])
        return out

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the tokens stay apart."""
        pair = ((a.astype(np.int64) << 20) | b) << 1
        with np.errstate(over="ignore"):
            place = ((pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int64) & (PAIRS - 1)
        known = self.pairs[place]
        out = (known & 1).astype(bool)
        new = np.flatnonzero(known >> 1 != pair >> 1)
        if len(new):
            fresh, back = np.unique(pair[new], return_inverse=True)
            stays = ~self.meets((fresh >> 21).astype(np.int32), ((fresh >> 1) & ((1 << 20) - 1)).astype(np.int32))
            out[new] = stays[back]
            self.pairs[place[new]] = pair[new] | stays[back]
        return out

    def fitting(self, tree: np.ndarray, token: np.ndarray, text: np.ndarray, n: int, last: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of ``rows`` of words, the one token that ends at byte ``n`` and fits the last token before it, and where
        it starts."""
        best, start = np.full(len(rows), -1, np.int32), np.zeros(len(rows), np.int32)
        open_, node = np.arange(len(rows)), np.zeros(len(rows), np.int32)
        for i in range(n - 1, -1, -1):
            node = tree[node, text[rows[open_], i]]
            alive = node >= 0
            open_, node = open_[alive], node[alive]
            if not len(open_):
                break
            found = token[node]
            hit = np.flatnonzero(found >= 0)
            if i and len(hit):
                hit = hit[self.apart(last[rows[open_[hit]], i - 1], found[hit])]
            if len(hit):
                best[open_[hit]], start[open_[hit]] = found[hit], i
                left = np.ones(len(open_), bool)
                left[hit] = False
                open_, node = open_[left], node[left]
        if (best < 0).any():
            raise ValueError("no token fits a prefix")
        return best, start

    def steps(self, words: list[str]) -> list[bytes]:
        """The steps of words, as signed bytes."""
        out: list[bytes] = [b""] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for at in range(0, len(order), BLOCK):
            block = order[at : at + BLOCK]
            raw = [words[i].lower().encode() for i in block]
            sizes = np.array([len(r) for r in raw])
            text = np.zeros((len(block), sizes.max()), np.uint8)
            text[np.arange(text.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(raw), np.uint8)
            ends = (np.pad(text, ((0, 0), (0, 1)))[:, 1:] & 0xC0) != 0x80  # a character ends where the next byte starts one
            text = self.number[text]
            last, count = np.zeros(text.shape, np.int32), np.zeros((len(block), text.shape[1] + 1), np.int32)
            total = np.zeros(text.shape, np.int32)
            for n in range(1, text.shape[1] + 1):
                rows = np.flatnonzero(sizes >= n)
                token, start = self.fitting(self.inner, self.inner_token, text, n, last, rows)
                last[rows, n - 1], count[rows, n] = token, count[rows, start] + 1
                rows = rows[ends[rows, n - 1]]
                _, start = self.fitting(self.final, self.final_token, text, n, last, rows)
                total[rows, n - 1] = count[rows, start] + 1
            inside = (np.arange(text.shape[1]) < sizes[:, None]) & ends
            flat = total[inside]
            chars = inside.sum(axis=1)
            first = np.cumsum(chars) - chars
            change = np.diff(flat, prepend=0)
            change[first] = flat[first]
            data = change.astype(np.int8).tobytes()
            for i, a, k in zip(block, first.tolist(), chars.tolist(), strict=True):
                out[i] = data[a : a + k]
        return out


class Counter:
    """Tokens of a growing text, one normalised character at a time; :meth:`mark` and :meth:`back` undo."""

    def __init__(self, vocab: Vocabulary, kind_of, bytes_of):
        self.vocab, self.kind_of, self.bytes_of = vocab, kind_of, bytes_of
        #: Tokens of closed pre-tokens; kind of the open one; its bytes, and the last token and count at each of its prefixes.
        self.base, self.kind = 0, SPACE
        self.bytes: list[str] = []
        self.last: list[str] = []
        self.count = [0]
        #: What followed an apostrophe that may start an ending: None, "" or one letter; and the tokens before it.
        self.quote: str | None = None
        self.before = 0

    def mark(self) -> tuple:
        return (self.base, self.kind, self.quote, self.before, self.bytes, self.last, self.count, len(self.bytes))

    def back(self, m: tuple) -> None:
        self.base, self.kind, self.quote, self.before, self.bytes, self.last, self.count, n = m
        del self.bytes[n:], self.last[n:], self.count[n + 1 :]

    def open(self, kind: int) -> None:
        self.kind, self.bytes, self.last, self.count = kind, [], [], [0]

    def push(self, ch: str) -> None:
        """A character's bytes at the end of the open pre-token."""
        text, last, count, inner, apart = self.bytes, self.last, self.count, self.vocab.inner, self.vocab.apart
        for b in self.bytes_of(ch):
            text.append(b)
            n = len(text)
            node, i = inner, n
            while i and (node := node.get(text[i - 1])) is not None:
                i -= 1
                token = node.get("")
                if token is not None and (not i or apart(last[i - 1], token)):
                    last.append(token)
                    count.append(count[i] + 1)
                    break
            else:
                raise ValueError(f"no token ends at byte {n} of {''.join(text)[:80]!r}")

    def closed(self) -> int:
        """Tokens of the open pre-token if it ended here."""
        text, n = self.bytes, len(self.bytes)
        if not n:
            return 0
        node, i = self.vocab.final, n
        while i and (node := node.get(text[i - 1])) is not None:
            i -= 1
            token = node.get("")
            if token is not None and (not i or self.vocab.apart(self.last[i - 1], token)):
                return self.count[i] + 1
        raise ValueError(f"no token ends {''.join(text)[:80]!r}")

    def one(self, text: str) -> int:
        """Tokens of a pre-token of its own."""
        c = Counter(self.vocab, self.kind_of, self.bytes_of)
        for ch in text:
            c.push(ch)
        return c.closed()

    def close(self) -> None:
        self.base, self.quote = self.base + self.closed(), None
        self.open(SPACE)

    def feed(self, ch: str) -> None:
        kind = self.kind_of(ch)
        quote, self.quote = self.quote, None
        if quote is not None and quote + ch in ENDINGS:
            self.base = self.before + self.one("'" + quote + ch)
            self.open(SPACE)
            return
        if kind == SPACE:
            self.close()
            return
        if quote == "" and kind == LETTER and ch in "rvl":
            self.close()
            self.quote = ch  # of these, 'r' alone is a letter of a new word
            self.open(LETTER)
        elif kind == NUMBER or kind != self.kind:
            self.close()
            self.open(kind)
            if ch == "'":
                self.quote, self.before = "", self.base
        self.push(ch)

    def total(self) -> int:
        return self.base + self.closed()


def byte_alphabet() -> list[str]:
    """The printable stand-ins of the 256 bytes: printable Latin-1 for itself, the rest from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class PrefixCounts:
    """The counter of a file.  :meth:`steps` gives, for each character of a text, how the count changes with it: as signed
    bytes, or as signed 32-bit numbers where one doesn't fit a byte."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        if not model.get("end_of_word_suffix") or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError("not a byte-level BPE file with word ends")
        self.tok = Tokenizer.from_file(path)
        self.vocab = Vocabulary(model)
        self.alphabet = byte_alphabet()
        self.special = sorted((t.content for t in self.tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.hint = os.path.commonprefix(self.special) if self.special else None
        self.kinds: dict[str, int] = {}
        self.norms: dict[str, str] = {}
        self.spelt: dict[str, str] = {}
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.words = WordTable(self.vocab, self.alphabet)
        self._joining: frozenset[str] | None = None

    def kind_of(self, ch: str) -> int:
        """As the file's own pattern has it."""
        kind = self.kinds.get(ch)
        if kind is None:
            cut = lambda s: len(self.tok.pre_tokenizer.pre_tokenize_str(s))
            kind = SPACE if not cut(ch) else LETTER if cut("a" + ch) == 1 else NUMBER if cut(ch + ch) == 2 else OTHER
            self.kinds[ch] = kind
        return kind

    def bytes_of(self, ch: str) -> str:
        s = self.spelt.get(ch)
        if s is None:
            s = self.spelt[ch] = "".join(self.alphabet[b] for b in ch.encode())
        return s

    def normal(self, ch: str) -> str:
        s = self.norms.get(ch)
        if s is None:
            s = self.norms[ch] = self.tok.normalizer.normalize_str(ch)
        return s

    @property
    def joining(self) -> frozenset[str]:
        """Characters that may compose with the one before without being marks."""
        if self._joining is None:
            pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
            second = {chr(int(p[1], 16)) for p in pairs if len(p) == 2 and not p[0].startswith("<")}
            self._joining = frozenset(second | {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))})
        return self._joining

    def _plain(self, text: str) -> list[int]:
        """Counts at the prefixes, 1 and longer, of a text without special tokens."""
        c = Counter(self.vocab, self.kind_of, self.bytes_of)
        norms = [self.normal(ch) for ch in text]
        counts = []
        if text.isascii() or self.tok.normalizer.normalize_str(text).replace(" ", "") == "".join(norms).replace(" ", ""):
            for s in norms:
                for ch in s:
                    c.feed(ch)
                counts.append(c.total())
            return counts
        # Characters that compose go in groups: each prefix of a group is normalised by itself, and fed from where it differs.
        at = 0
        while at < len(text):
            end = at + 1
            while end < len(text) and (unicodedata.combining(text[end]) or text[end] in self.joining):
                end += 1
            fed, marks = "", [c.mark()]
            for k in range(at + 1, end + 1):
                want = self.tok.normalizer.normalize_str(text[at:k]) if k > at + 1 else norms[at]
                same = len(os.path.commonprefix((fed, want)))
                if same < len(fed):
                    c.back(marks[same])
                    del marks[same + 1 :]
                for ch in want[same:]:
                    c.feed(ch)
                    marks.append(c.mark())
                fed = want
                counts.append(c.total())
            at = end
        return counts

    def counts(self, text: str) -> list[int]:
        """Counts at every prefix of a text, the empty one first."""
        out, at = [0], 0
        while at < len(text):
            found = [(i, -len(s), s) for s in self.special if (i := text.find(s, at)) >= 0]
            start, _, token = min(found) if found else (len(text), 0, "")
            # A special token cut short is ordinary text.
            base = out[-1]
            out += [base + n for n in self._plain(text[at : start + max(0, len(token) - 1)])]
            if token:
                out.append((out[start] if start > at else base) + 1)
            at = start + len(token)
        return out

    def _odd(self, chunk: str) -> bytes:
        """Steps of a chunk as bytes, or as 32-bit numbers if one is large (told by the length)."""
        return packed_steps(self.counts(chunk))

    def _fill(self, chunks: list[str]) -> dict[str, bytes]:
        """Steps of distinct chunks."""
        out, words, plain = {}, {}, []
        for c in chunks:
            word = c.rstrip(SYMBOLS)
            if len(word) < len(c) and self.hint and self.hint in c or not WORD.fullmatch(word):
                out[c] = self._odd(c)
                continue
            end = c[len(word) :]  # after a letter, symbols are a pre-token of their own
            if end and end not in self.tails:
                if len(self.tails) > 10_000:
                    self.tails.clear()
                self.tails[end] = self._odd(end)
            if len(self.tails.get(end, b"")) != len(end):
                out[c] = self._odd(c)
                continue
            words.setdefault(word, len(words))
            plain.append((c, word, self.tails.get(end, b"")))
        if plain:
            steps = self.words.steps(list(words))
            for c, word, tail in plain:
                out[c] = steps[words[word]] + tail
        return out

    def steps(self, texts: list[str]) -> list[np.ndarray]:
        """For each text, the change of the count with each character, int8 or int32."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and size < TOGETHER:
                size, end = size + len(texts[end]), end + 1
            cut = [t.replace("\n", " ").replace("\t", " ").split(" ") for t in texts[at:end]]
            if len(self.new) >= CACHE_ENTRIES // 2:
                self.old, self.new = self.new, {}
            wanted = set().union(*cut).difference(self.new)
            here = {c: s for c in wanted if (s := self.old.get(c)) is not None}
            here |= self._fill([c for c in wanted if c not in here])
            self.new.update(here)
            for t, chunks in zip(texts[at:end], cut, strict=True):
                found = [self.new[c] for c in chunks]
                whole = b"\0".join(found)
                if len(whole) == len(t):
                    out.append(np.frombuffer(whole, np.int8))
                else:
                    wide = [np.frombuffer(f, np.int8 if len(f) == len(c) else "<i4") for c, f in zip(chunks, found, strict=True)]
                    out.append(np.concatenate([x.astype(np.int32) for w in wide for x in (np.zeros(1), w)][1:]))
            for c in wanted:
                if len(c) > CACHE_CHARS:
                    del self.new[c]
            at = end
        return out


def packed_steps(counts: list[int]) -> bytes:
    change = np.diff(counts)
    return change.astype(np.int8 if not len(change) or np.abs(change).max() < 128 else "<i4").tobytes()


_counters: dict[str, PrefixCounts] = {}


def counter(path: str) -> PrefixCounts:
    """The counter of a file.  A Python worker keeps the last one with what it remembers for its later tasks."""
    if path not in _counters:
        _counters.clear()
        _counters[path] = PrefixCounts(path)
    return _counters[path]


COUNTS = "doc_id long, n_bytes long, n_chars long, n_tokens long, over_limit boolean"


def count_tokens(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, with_steps: bool = False,
) -> DataFrame:
    """``COUNTS`` of each document and, on request, ``steps``: the change of the count with each character, as signed bytes,
    or signed 32-bit numbers where one doesn't fit (then four times as many).  Their running sum is the count at every
    prefix; :func:`cut_to` answers budgets from it."""
    ddl = COUNTS + (", steps binary" if with_steps else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            steps = c.steps(texts)
            n = [int(s.sum(dtype=np.int64)) for s in steps]
            columns = [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n])]
            if with_steps:
                columns.append(pa.array([s.astype(s.dtype.newbyteorder("<")).tobytes() for s in steps], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in ddl.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ddl)


CUTS = "doc_id long, budget long, n_chars long, n_tokens long"


def cut_to(counts: DataFrame, budgets: list[int]) -> DataFrame:
    """``CUTS``: the longest prefix of each document that has at most so many tokens, for each budget, from the stored
    ``counts`` (with steps) alone.  A longer prefix can have fewer tokens than a shorter one; the last that fits counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, n_chars, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                total = np.concatenate(([0], np.cumsum(np.frombuffer(raw, np.int8 if len(raw) == n_chars else "<i4"), dtype=np.int64)))
                # The least count from here to the end falls only where no later prefix is as short.
                least = np.minimum.accumulate(total[::-1])[::-1]
                for budget in budgets:
                    k = int(np.searchsorted(least, budget, "right")) - 1
                    out.append((doc_id, budget, max(k, 0), int(total[max(k, 0)])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], names=[x.split()[0] for x in CUTS.split(", ")])

    return counts.select("doc_id", "n_chars", "steps").mapInArrow(run, CUTS)
