"""The few functions that Spark has no built-in for, as Arrow-batched UDFs."""

from __future__ import annotations

import hashlib
import itertools
import re
import unicodedata
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"[^\W_]+(?:['’-][^\W_]+)?")
_SPAN = re.compile(r"\S+")


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(c: Column) -> Column:
    """Unicode compatibility form; only texts that aren't ASCII go to Python."""
    ascii_only = c.rlike(r"^[\x00-\x7F]*$")
    return F.coalesce(F.when(ascii_only, c), _nfkc(F.when(~ascii_only, c)))


@F.pandas_udf(T.StringType())
def nfkc_casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", x).casefold()))


def folded_key(c: Column) -> Column:
    """Exact Unicode case folding; Python is called only for texts that aren't ASCII."""
    ascii_only = c.rlike(r"^[\x00-\x7F]*$")
    return F.coalesce(F.when(ascii_only, F.lower(c)), nfkc_casefold(F.when(~ascii_only, c)))


#: N-gram sizes and weights of the embedding's two kinds of features.
WORD_GRAMS, LETTER_GRAMS, LETTER_WEIGHT = (1, 2), (3, 4), 0.35
#: Words and letter n-grams that a Python worker remembers the features of; rows and characters that it embeds at a time (a longer text is alone).
REMEMBERED, ROWS, CHARACTERS = 250_000, 256, 1 << 18


class Numbers(dict):
    """A number for each distinct word, in order of first sight."""

    def __init__(self):
        super().__init__()
        self.words: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self.words)
        self.words.append(word)
        return n


class Folded(Numbers):
    """Numbers in which words that differ in case only are equal."""

    def __init__(self):
        super().__init__()
        self.own = Numbers()

    def __missing__(self, word: str) -> int:
        n = self[word] = self.own[word.casefold()]
        return n


class Embedder:
    """Feature hashing of word and letter n-grams, of unit length (zero without a token).

    A batch's words become numbers once; what follows is arrays: counts of (row, word), a table of each word's features, and one bincount. Features are hashed in bulk, letters' once.
    """

    def __init__(self, size: int = 768):
        if size < 32:
            raise ValueError("an embedding has 32 dimensions at least")
        self.size = size
        self.forget()

    def forget(self) -> None:
        self.numbers, self.grams = Folded(), Numbers()
        self.start, self.gram_of = np.zeros(1, np.int64), np.zeros(0, np.int64)
        self.gram_at, self.gram_value = np.zeros(0, np.int64), np.zeros(0)
        self.word_at, self.word_value = np.zeros(0, np.int64), np.zeros(0)

    def hashed(self, features: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Dimension and sign of each feature."""
        blake = hashlib.blake2b
        raw = np.frombuffer(b"".join([blake(f.encode(), digest_size=8).digest() for f in features]), "<u8")
        return (raw % np.uint64(self.size)).astype(np.int64), np.where(raw >> np.uint64(63), -1.0, 1.0)

    def learned(self) -> None:
        """Adds the words and the letter n-grams that are new to the tables."""
        new = self.numbers.own.words[len(self.word_at) :]
        if not new:
            return
        at, value = self.hashed([f"w:{w}" for w in new])
        self.word_at, self.word_value = np.concatenate([self.word_at, at]), np.concatenate([self.word_value, value])
        marked = [f"^{w}$" for w in new]
        parts = [[m[i : i + n] for n in LETTER_GRAMS for i in range(len(m) - n + 1)] for m in marked]
        found = np.fromiter(map(self.grams.__getitem__, itertools.chain.from_iterable(parts)), np.int64)
        self.gram_of = np.concatenate([self.gram_of, found])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum([len(x) for x in parts])])
        fresh = self.grams.words[len(self.gram_at) :]
        at, value = self.hashed([f"c{len(g)}:{g}" for g in fresh])
        self.gram_at, self.gram_value = np.concatenate([self.gram_at, at]), np.concatenate([self.gram_value, value * LETTER_WEIGHT / np.sqrt([len(g) for g in fresh])])

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if max(len(self.numbers), len(self.grams)) > REMEMBERED:
            self.forget()
        found = [_TOKEN.findall(t or "") for t in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(map(self.numbers.__getitem__, itertools.chain.from_iterable(found)), np.int64, int(sizes.sum()))
        rows = np.repeat(np.arange(len(texts)), sizes)
        self.learned()
        held, counts = np.unique(rows << 32 | ids, return_counts=True)
        own, of = held & 0xFFFFFFFF, held >> 32
        flat, value = [of * self.size + self.word_at[own]], [counts * self.word_value[own]]
        many = self.start[own + 1] - self.start[own]
        at = self.gram_of[np.repeat(self.start[own] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(int(many.sum()))]
        flat.append(np.repeat(of, many) * self.size + self.gram_at[at]), value.append(np.repeat(counts, many) * self.gram_value[at])
        near = np.flatnonzero(rows[:-1] == rows[1:])
        if len(near):
            words = self.numbers.own.words
            keys, each = np.unique(ids[near] << 32 | ids[near + 1], return_inverse=True)
            where, sign = self.hashed([f"w:{words[a]}\x1f{words[b]}" for a, b in zip((keys >> 32).tolist(), (keys & 0xFFFFFFFF).tolist(), strict=True)])
            flat.append(rows[near] * self.size + where[each]), value.append(sign[each] / np.sqrt(2))
        out = np.bincount(np.concatenate(flat), np.concatenate(value), len(texts) * self.size).astype(float).reshape(len(texts), self.size)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0).astype(np.float32)


def embed(text: str, size: int = 768) -> np.ndarray:
    """The embedding of one text."""
    return Embedder(size)([text])[0]


def pieces(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Texts in order, ROWS and CHARACTERS at a time."""
    start = held = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > start and (i - start == ROWS or held + n > CHARACTERS):
            yield texts[start:i]
            start, held = i, 0
        held += n
    if start < len(texts):
        yield texts[start:]


def hash_embed(c: Column, size: int = 768) -> Column:
    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder = Embedder(size)
        for s in batches:
            for texts in pieces(s.tolist()):  # vectors leave as they are made: a batch of them isn't held
                yield pd.Series(list(embedder(texts)), dtype=object)

    return run(c)


def model_embed(c: Column, load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 256) -> Column:
    """Embeddings of a model that the caller brings: load() runs once in each Python worker and returns texts -> matrix; rows are scaled to unit length, null texts are empty."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for s in batches:
            texts = [x or "" for x in s.tolist()]
            for i in range(0, len(texts), batch):
                x = np.asarray(encode(texts[i : i + batch]), np.float64)
                norm = np.linalg.norm(x, axis=1, keepdims=True)
                yield pd.Series(list(np.divide(x, norm, out=np.zeros_like(x), where=norm > 0).astype(np.float32)), dtype=object)

    return run(c)


def best_span(quote: str | None, source: str | None, threshold: float) -> tuple[bool, float, int, int, str | None]:
    """The window of tokens, of two fewer to two more than the quote's, that is most like it; the earliest of equals. Valid from the threshold on.

    Letters that a window has in common with the quote bound its ratio. The bounds of all windows come from running sums of letter counts; windows are
    compared from the highest bound down, until none that is left can be better.
    """
    spans = [m.span() for m in _SPAN.finditer(source or "")]
    want = " ".join((quote or "").split()).casefold()
    if not want or not spans:
        return False, 0.0, -1, -1, None
    tokens = [source[a:b].casefold() for a, b in spans]
    letters = {ch: k for k, ch in enumerate(sorted(set(want) - {" "}))}
    need = np.array([want.count(ch) for ch in letters], np.int64)
    counts = np.zeros((len(tokens) + 1, len(letters)), np.int64)
    for i, t in enumerate(tokens, 1):
        for ch in t:
            if ch in letters:
                counts[i, letters[ch]] += 1
    counts = np.cumsum(counts, 0)
    length = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
    n = len(quote.split())
    bounds, windows = [], []
    for width in range(max(1, n - 2), min(n + 2, len(tokens)) + 1):
        first = np.arange(len(tokens) - width + 1)
        common = np.minimum(counts[first + width] - counts[first], need).sum(1) + min(width - 1, n - 1)
        bounds.append(2 * common / (len(want) + length[first + width] - length[first] + width - 1))
        windows.append(np.stack([first, np.full(len(first), width)], 1))
    if not bounds:
        return False, 0.0, -1, -1, None
    bound, window = np.concatenate(bounds), np.concatenate(windows)
    best = (0.0, 0, 0)
    for k in np.argsort(-bound, kind="stable").tolist():
        if bound[k] < -best[0] - 1e-12:
            break
        i, width = window[k].tolist()
        r = SequenceMatcher(None, want, " ".join(tokens[i : i + width])).ratio()
        if r > 0:
            best = min(best, (-r, spans[i][0], spans[i + width - 1][1]))
    r, a, b = -best[0], best[1], best[2]
    valid = r > 0 and r >= threshold
    return (True, round(r, 6), a, b, source[a:b]) if valid else (False, round(r, 6), -1, -1, None)


def fuzzy_span(quote: Column, source: Column, threshold: float = 0.92) -> Column:
    """best_span() as struct<valid, score, start, end, span>. Filter exact hits out first."""

    @F.pandas_udf("valid boolean, score double, start int, end int, span string")
    def run(q: pd.Series, s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([best_span(a, b, threshold) for a, b in zip(q, s, strict=True)], columns=["valid", "score", "start", "end", "span"])

    return run(quote, source)
