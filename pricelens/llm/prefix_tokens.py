"""Exact token counts at every prefix of a text, by dynamic programming.

For byte-level BPE the last token of a prefix is unique: it is the one
vocabulary entry that ends there and that the merges would leave beside the
last token of the prefix before it. So with ``count[0] = 0``::

    count[i] = count[i - len(last[i])] + 1

one sweep over a pre-token's bytes gives the exact count at each of its
prefixes. Pre-tokens are independent, so a text's table is the running sum of
its pre-tokens' tables; tables of words are kept per Python worker (at most
``_CACHE`` of them), and questions about truncation or budgets are answered
from the tables without encoding the text again.

Cases: a null text counts as empty (0 tokens); whole texts of any length are
processed; special strings inside a text count one token each, as the library
does by default.
"""

from __future__ import annotations

import bisect
import itertools
import json

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

_CACHE = 600_000
#: Fixed value: the published splitting pattern of the byte-level vocabulary.
_PRETOKENS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: A coarser split whose pieces the pattern above never crosses.
_CHUNKS = regex.compile(r" ?\P{White_Space}+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
_SPACE = regex.compile(r"\p{White_Space}+")
_BYTE = (-1, -1, -1)  # a token that no merge made
_CONTRACTIONS = ("'re", "'ve", "'ll", "'s", "'t", "'m", "'d")  # fixed values


def byte_letters() -> list[str]:
    """The published printable alphabet of byte-level BPE: the letter of each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = itertools.count(256)
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class PrefixCounter:
    """Token counts of prefixes under one byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = {letter: b for b, letter in enumerate(byte_letters())}
        raw = lambda token: bytes(alphabet[c] for c in token)
        special = {t["content"] for t in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        self.ids = {raw(t): i for t, i in vocab.items() if t not in special}
        self.found = ahocorasick.Automaton()  # every vocabulary entry that ends at each byte
        for token, i in self.ids.items():
            self.found.add_word(token.decode("latin-1"), (len(token), i))
        self.found.make_automaton()
        self.rank, self.parts = {}, {}  # merge order of a pair; a token's two halves
        for order, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, whole = self.ids[raw(a)], self.ids[raw(b)], self.ids[raw(a) + raw(b)]
            self.rank[left, right] = order
            self.parts.setdefault(whole, (order, left, right))
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.adjacent: dict[tuple[int, int], bool] = {}
        self.words: dict[str, list[int]] = {}
        self.totals = _Totals(self)

    def stay_apart(self, left: int, right: int) -> bool:
        """True if the merges leave the two tokens side by side.

        Takes back the later of the two tokens' own merges, again and again: a
        pair that touches across the border must not have had its turn before
        the merge just taken back. Of equal merges the left one went first.
        """
        got = self.adjacent.get((left, right))
        if got is not None:
            return got
        a, b, before = left, right, 1 << 60
        while True:
            if self.rank.get((a, b), before) < before:
                got = False
                break
            made_a, made_b = self.parts.get(a, _BYTE), self.parts.get(b, _BYTE)
            if made_a is _BYTE and made_b is _BYTE:
                got = True
                break
            if made_a[0] > made_b[0]:
                before, a = made_a[0], made_a[2]
            else:
                before, b = made_b[0] + 1, made_b[1]
        if len(self.adjacent) >= _CACHE:
            self.adjacent.clear()
        self.adjacent[left, right] = got
        return got

    def _sweep(self, word: str) -> list[int]:
        data = word.encode()
        last, count = [-1] * (len(data) + 1), [0] * (len(data) + 1)
        done, known, apart = 0, self.adjacent, self.stay_apart
        for at, (size, token) in self.found.iter(data.decode("latin-1")):  # at each end the longest entry first
            end = at + 1
            if end == done:
                continue
            start = end - size
            if start:
                before = last[start]
                fits = known.get((before, token))
                if fits is None:
                    fits = apart(before, token)
                if not fits:
                    continue
            last[end], count[end], done = token, count[start] + 1, end
        if len(data) == len(word):
            return count[1:]
        ends = [i for i in range(1, len(data)) if data[i] & 0xC0 != 0x80] + [len(data)]
        return [count[i] for i in ends]

    def word(self, word: str) -> list[int]:
        """Counts at the prefixes of 1, 2, .. characters of one pre-token."""
        got = self.words.get(word)
        if got is None:
            got = self._sweep(word)
            if word in _CONTRACTIONS and len(word) == 3:  # cut there, its letter is a pre-token of its own
                got[1] = self._sweep(word[0])[-1] + self._sweep(word[1])[-1]
            if len(word) <= 64:
                if len(self.words) >= _CACHE:
                    self.words.clear()
                self.words[word] = got
        return got

    def chunk(self, chunk: str) -> list[int]:
        """Counts at the prefixes of a chunk (a word with what touches it, or a run of white space)."""
        out, base = [], 0
        for w in _PRETOKENS.findall(chunk):
            table = self.word(w)
            out += [base + v for v in table] if base else table
            base = out[-1]
        return out

    def piece(self, piece: str) -> list[int]:
        """A chunk as the fast split has it: "\nword" or, without its blank, "word"."""
        if piece[:1] != "\n":
            return self.chunk(" " + piece)
        first = self.chunk("\n")
        return first + [first[-1] + v for v in self.chunk(piece[1:])]

    def _segment(self, text: str) -> list[int]:
        """Counts at the prefixes of 1, 2, .. characters of a text without special strings."""
        out, base, blank, blank_base = [], 0, "", 0
        for c in _CHUNKS.findall(text):
            table = self.chunk(c)
            out += [base + v for v in table] if base else table
            if blank and _SPACE.match(c):  # the prefix that ends with the whole run: one run, not two
                out[-len(c)] = blank_base + self.chunk(blank + c[0])[-1]
            blank, blank_base = (c, base) if _SPACE.fullmatch(c) and not blank else ("", 0)
            base = base + table[-1]
        return out

    def table(self, text: str) -> np.ndarray:
        """``table[i]`` is the exact number of tokens of ``text[:i]``, for i = 0 .. len(text)."""
        out, base, at = [0], 0, 0
        for m in self.special.finditer(text) if self.special and "<" in text else ():
            part = self._segment(text[at:m.start()] + m[0][:-1])  # cut inside, a special string is plain text
            out += [base + v for v in part]
            base += (self._segment(text[at:m.start()]) or [0])[-1] + 1
            out.append(base)
            at = m.end()
        out += [base + v for v in self._segment(text[at:])]
        return np.array(out, dtype=np.int32)

    def count(self, text: str, budget: int | None = None) -> tuple[int, int]:
        """Tokens of the whole text, and the characters of its longest prefix
        with at most ``budget`` tokens (all of them without a budget)."""
        if not text:
            return 0, 0
        lined = "\n" + text
        pieces = lined.replace("\n", " \n").split(" ")[1:]
        words = lined.split()
        # as many words as pieces, and no white space but blanks and line breaks: these stand alone between words
        plain = len(words) == len(pieces) and sum(map(len, words)) == len(lined) - lined.count(" ") - lined.count("\n")
        if not plain or self.special and "<" in text and self.special.search(text):
            table = self.table(text)
            total = int(table[-1])
            fits = len(text) if budget is None or total <= budget else int(np.flatnonzero(table <= budget)[-1])
            return total, fits
        counts = list(map(self.totals.__getitem__, pieces))
        total = sum(counts) - 1  # the line break put before the text
        if budget is None or total <= budget:
            return total, len(text)
        before = list(itertools.accumulate(counts, initial=-1))
        k = bisect.bisect_left(before, budget) - 1  # the last piece that begins below the budget
        start = sum(map(len, pieces[:k])) + k - sum(p[0] == "\n" for p in pieces[:k]) - 1
        table = self.piece(pieces[k])
        fits = max((j + 1 for j, v in enumerate(table) if before[k] + v <= budget), default=0)
        return total, max(0, start + fits)


class _Totals(dict):
    """Tokens of a piece, counted when first met; emptied when full."""

    def __init__(self, counter: PrefixCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, piece: str) -> int:
        c, chunk = self.counter, " " + piece
        if piece[0] == "\n":
            chunk, total = piece[1:], c.word("\n")[-1]
        else:
            total = 0
        total += sum(c.word(w)[-1] for w in _PRETOKENS.findall(chunk))
        if len(piece) <= 64:
            if len(self) >= _CACHE:
                self.clear()
            self[piece] = total
        return total


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """The process's counter of a vocabulary file; its word tables outlive a task."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


_COUNTED = pa.struct([("n_tokens", pa.int64()), ("fit_chars", pa.int64())])


def token_counts(text: Column, path: str, budget: int) -> Column:
    """struct(n_tokens, fit_chars): tokens of the whole text, and how many
    characters of it can stay if at most ``budget`` tokens may."""
    @arrow_udf("struct<n_tokens: long, fit_chars: long>")
    def counts(texts: pa.Array) -> pa.Array:
        c = counter(path)
        got = [c.count(t.as_py() or "", budget) for t in texts]
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())],
                                          fields=list(_COUNTED))

    return counts(text)


def prefix_table(text: Column, path: str) -> Column:
    """array<int> with the exact token count at every prefix of 0, 1, .. characters."""
    @arrow_udf("array<int>")
    def tables(texts: pa.Array) -> pa.Array:
        c = counter(path)
        got = [c.table(t.as_py() or "") for t in texts]
        ends = np.cumsum([0] + [len(g) for g in got]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(got) if got else np.array([], np.int32)))

    return tables(text)


def tokens_of_prefix(table: Column, n_chars: Column) -> Column:
    """Tokens of the first ``n_chars`` characters, read from a stored table."""
    return F.element_at(table, (F.least(F.greatest(n_chars, F.lit(0)), F.size(table) - 1) + 1).cast("int"))


def longest_prefix(table: Column, budget: Column) -> Column:
    """Characters of the longest prefix with at most ``budget`` tokens, read from a stored table."""
    return F.array_max(F.transform(table, lambda v, i: F.when(v <= budget, i)))


def count_documents(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_chars of every document's whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return (docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"),
                        token_counts(F.col("text"), path, limit).alias("c"))
            .select("doc_id", "n_bytes", "c.n_tokens", (F.col("c.n_tokens") > limit).alias("over_limit"), "c.fit_chars"))
