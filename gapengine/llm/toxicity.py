"""Toxicity scores from misspelling-tolerant lexicon hits and the windows around them.

A lexicon of words and word stems is learned from a bounded sample of labelled rows. Its trie is intersected with Levenshtein
automata: states of the product are sets of (trie node, edits), made deterministic on demand, so each new word costs a few
dictionary lookups per letter. Hits are weighed by how they split toxic from clean rows; the words around a hit and quotation
marks around it separate abuse from quotation. A ridge logistic regression turns a text's sums into a probability.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapengine.llm import common as c

#: Bounds of the sample that the model is fitted on: labelled rows of each class, those with the least md5 of doc_id.
SAMPLE = {1: 2500, 0: 5000}
WINDOW, THRESHOLD = 6, 0.3
EDGES = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~«»“”„‘’…"
QUOTES = frozenset('"«»“”„‘’`')
#: The z statistic that a term of the lexicon needs.
Z = 4.0
#: Classes of terms by how well they tell, each with a count of its own among a text's features.
CLASSES = 8
#: Words with the edges stripped that are remembered in a Python worker before it starts anew.
REMEMBERED = 200_000
#: Rows of a batch that are scored at a time.
ROWS = 512


def budget(term: str) -> int:
    """Edits that a whole-word term may be away."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Matcher:
    """All terms that a word is, starts with (stems end in *) or comes near; a lazily determinised automaton."""

    def __init__(self, terms: Iterable[str]):
        self.terms = list(terms)
        self.children: list[dict[str, int]] = [{}]
        self.whole: list[int] = [-1]
        self.stem: list[int] = [-1]
        self.most: list[int] = [0]  # edits that some term below allows
        for k, term in enumerate(self.terms):
            is_stem, text = term.endswith("*"), term.rstrip("*")
            allowed, node = 0 if is_stem else budget(text), 0
            self.most[0] = max(self.most[0], allowed)
            for ch in text:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({}), self.whole.append(-1), self.stem.append(-1), self.most.append(0)
                node = self.children[node][ch]
                self.most[node] = max(self.most[node], allowed)
            (self.stem if is_stem else self.whole)[node] = k
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.ends: list[tuple[tuple[int, int], ...]] = []
        self.stems: list[tuple[int, ...]] = []
        self.start = self._state({0: 0})

    def _state(self, edits: dict[int, int]) -> int:
        todo = list(edits.items())
        while todo:  # a letter of the term is left out
            node, e = todo.pop()
            for child in self.children[node].values():
                if e < self.most[child] and e + 1 < edits.get(child, 99):
                    edits[child] = e + 1
                    todo.append((child, e + 1))
        key = frozenset(edits.items())
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            self.ends.append(tuple(sorted((k, e) for node, e in key if (k := self.whole[node]) >= 0 and e <= budget(self.terms[k]))))
            self.stems.append(tuple(k for node, e in key if e == 0 and (k := self.stem[node]) >= 0))
        return self.ids[key]

    def _move(self, state: int, ch: str) -> int:
        edits: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.most[node] and e < edits.get(node, 99):
                edits[node] = e

        for node, e in self.states[state]:
            for letter, child in self.children[node].items():
                if letter == ch:
                    if e < edits.get(child, 99):
                        edits[child] = e
                else:
                    reach(child, e + 1)
            reach(node, e + 1)
        out = self.moves[state][ch] = self._state(edits)
        return out

    def __call__(self, word: str) -> tuple[tuple[int, int], ...]:
        state, stems = self.start, ()
        for ch in word:
            nxt = self.moves[state].get(ch, -1)
            state = nxt if nxt >= 0 else self._move(state, ch)
            if not self.states[state]:
                return tuple((k, 0) for k in stems)
            if self.stems[state]:
                stems += self.stems[state]
        return tuple((k, 0) for k in stems) + self.ends[state]


class Memory(dict):
    """A number for each raw word, and the word's hits by that number."""

    def __init__(self, match: Matcher):
        super().__init__()
        self.match = match
        self.words: list[str] = []
        self.hits: list[tuple[tuple[int, int], ...]] = []

    def __missing__(self, word: str) -> int:
        out = self[word] = len(self.words)
        self.words.append(word)
        self.hits.append(self.match(word.strip(EDGES)))
        return out

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def around(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of values over the windows before and after the positions at."""
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[at] - sums[np.maximum(at - WINDOW, 0)], sums[np.minimum(at + 1 + WINDOW, len(values))] - sums[at + 1]


@dataclass
class Model:
    terms: list[str]
    exact: np.ndarray
    fuzzy: np.ndarray
    context: dict[str, float]
    coefficients: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def classes(self) -> np.ndarray:
        """The class of each term: equally many in each, by falling weight."""
        out = np.zeros(len(self.terms), np.int64)
        out[np.lexsort((np.arange(len(self.terms)), -self.exact))] = np.arange(len(self.terms)) * CLASSES // max(1, len(self.terms))
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        x = np.clip(x, self.low, self.high)  # a text that is longer than all that were learned from isn't told by its length
        z = ((x - self.centre) / self.scale) @ self.coefficients[1:] + self.coefficients[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Features:
    """Features of texts as rows: sums over plain and quoted hits, the strongest one, shares, the hits' windows, and a count of exact hits for each class of terms. A word is looked up once; the rest is sums of arrays."""

    def __init__(self, model: Model, match: Matcher | None = None):
        self.model, self.memory = model, Memory(match or Matcher(model.terms))
        self.classes = model.classes()
        self.table, self.known = np.zeros((1024, 7 + CLASSES), np.float32), 0

    def _grown(self) -> np.ndarray:
        """For each word known: has hits, weight, only near hits, context, holds a quotation mark, begins with one, ends with one; exact hits by class."""
        m, old, n = self.model, self.known, len(self.memory.words)
        if old < n:
            while len(self.table) < n:
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            words = self.memory.words[old:n]
            self.table[old:n, 3] = [m.context.get(w.strip(EDGES), 0.0) for w in words]
            for k, w in enumerate(words, old):
                if not QUOTES.isdisjoint(w):
                    self.table[k, 4:7] = 1, w[0] in QUOTES, w[-1] in QUOTES
                if found := self.memory.hits[k]:
                    self.table[k, :3] = 1, max(m.exact[t] if e == 0 else m.fuzzy[t] for t, e in found), all(e > 0 for _, e in found)
                    for t, e in found:
                        self.table[k, 7 + self.classes[t]] += e == 0
            self.known = n
        return self.table

    def __call__(self, words: list[str]) -> tuple[np.ndarray, int]:
        """Of one text, and its hits."""
        if len(self.memory) > REMEMBERED:
            self.memory, self.known = Memory(self.memory.match), 0
            self.table[:] = 0
        own = self.memory.numbers(words)
        rows = self._grown()[own].astype(np.float64)
        out, at = np.zeros(8 + CLASSES), np.flatnonzero(rows[:, 0])
        out[5] = np.log1p(len(words))
        if len(at):
            before, after = around(rows[:, 4], at)
            cited = ((before > 0) | (rows[at, 5] > 0)) & ((after > 0) | (rows[at, 6] > 0))
            weight = rows[at, 1]
            plain, quoted, n = weight[~cited].sum(), weight[cited].sum(), len(at)
            out[:5] = np.sign(plain) * np.log1p(abs(plain)), np.sign(quoted) * np.log1p(abs(quoted)), max(0.0, weight.max()), np.log1p(100 * n / max(10, len(words))), sum(x.sum() for x in around(rows[:, 3], at)) / n
            out[6:8] = rows[at, 2].sum() / n, np.log1p(n)
            out[8:] = np.log1p(rows[at, 7:].sum(0))
        return out, len(at)


def lexicon(texts: list[str], labels: np.ndarray) -> list[str]:
    """The words and stems (4 to 7 letters and *) that split the classes, by the z statistic of their document shares. The sample alone bounds them.

    A term needs the z that the best of as many chance terms as there are candidates would reach (Z at least), and two to four toxic rows, by the number of those.
    """
    def terms(text: str) -> set[str]:
        cores = {w.strip(EDGES) for w in set(text.split())} - {""}
        return cores | {f"{w[:n]}*" for w in cores for n in range(4, 8) if len(w) > n}

    df: tuple[Counter, Counter] = (Counter(), Counter())
    for text, y in zip(texts, labels, strict=True):
        if y:
            df[1].update(terms(text))
    candidates = len(df[1])
    for text, y in zip(texts, labels, strict=True):
        if not y:
            df[0].update(terms(text) & df[1].keys())
    n1, n0 = max(1, int(labels.sum())), max(1, int(len(labels) - labels.sum()))
    least = 2 if n1 < 50 else 3 if n1 < 250 else 4
    bar = max(Z, np.sqrt(2 * np.log(max(2, candidates))))
    out = []
    for term, a in df[1].items():
        b = df[0][term]
        if a >= least and a / n1 > 2 * b / n0:
            p = (a + b) / (n1 + n0)
            if (a / n1 - b / n0) / np.sqrt(max(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0)) >= bar:
                out.append(term)
    return sorted(out)


def regression(x: np.ndarray, y: np.ndarray, weights: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted ridge logistic regression by Newton steps: coefficients with the intercept first, centre, scale."""
    centre, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1
    z = np.hstack([np.ones((len(x), 1)), (x - centre) / scale])
    beta, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (weights * p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (weights * (y - p)) - penalty * beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta, centre, scale


def fit(texts: list[str | None], labels: list[int], share: float | None = None) -> Model:
    """The model of labelled texts; without both classes it scores every text with the share of toxic ones (0.05 of none).

    share: of toxic rows among all labelled ones, if texts are a sample that hasn't it; the classes are weighed by it, so that a score is a probability at any size.
    """
    # copies of a text count once: a term that only they share says nothing
    distinct = dict.fromkeys(zip((t or "" for t in texts), labels, strict=True))
    texts, labels = [t for t, _ in distinct], [y for _, y in distinct]
    del distinct
    y = np.array(labels, float)
    texts = [t.lower() for t in texts]  # split anew in each pass: words take ten times the room
    terms = lexicon(texts, y) if 0 < y.sum() < len(y) else []
    memory = Memory(Matcher(terms))
    k = len(terms)
    counts = np.zeros((2, 2, k))
    near: tuple[Counter, Counter] = (Counter(), Counter())
    for t, label in zip(texts, y.astype(int), strict=True):
        if len(memory) > REMEMBERED:
            memory = Memory(memory.match)
        w = t.split()
        found = [(i, h) for i, h in enumerate([memory.hits[x] for x in memory.numbers(w).tolist()]) if h]
        for t, e in {(t, min(e, 1)) for _, h in found for t, e in h}:
            counts[label, e, t] += 1
        for i, _ in found:
            near[label].update(x.strip(EDGES) for x in w[max(0, i - WINDOW) : i] + w[i + 1 : i + 1 + WINDOW])
    n1, n0 = max(1.0, y.sum()), max(1.0, len(y) - y.sum())
    odds = np.log((counts[1] + 0.5) / (n1 + 1)) - np.log((counts[0] + 0.5) / (n0 + 1))
    unseen = counts[0, 1] + counts[1, 1] < 3
    fuzzy = np.where(unseen, odds[0] - 1, np.minimum(odds[1], odds[0]))
    m1, m0 = sum(near[1].values()) + 1, sum(near[0].values()) + 1
    context = {w: float(np.log((near[1][w] + 1) / m1) - np.log((near[0][w] + 1) / m0)) for w, n in (near[0] + near[1]).items() if n >= 20}
    model = Model(terms, odds[0] if k else np.zeros(0), fuzzy if k else np.zeros(0), context, np.zeros(9 + CLASSES), np.zeros(8 + CLASSES), np.ones(8 + CLASSES), np.full(8 + CLASSES, -np.inf), np.full(8 + CLASSES, np.inf))
    if not terms:
        share = min(0.95, max(0.05, y.mean() if len(y) else 0.0))
        model.coefficients[0] = np.log(share / (1 - share))
        return model
    features = Features(model, memory.match)
    x = np.array([features(t.split())[0] for t in texts])
    model.low, model.high = x.min(0), x.max(0)
    own = y.mean()
    share = own if share is None else share
    model.coefficients, model.centre, model.scale = regression(x, y, np.where(y == 1, share / own, (1 - share) / (1 - own)))
    return model


def train(docs: DataFrame, labels: DataFrame, may_learn=None) -> Model:
    """Fits on at most SAMPLE labelled rows of docs: labels(doc_id, toxic); may_learn: a condition on doc_id.

    Only ids of the bounded sample are broadcast, and only their texts come to the driver. Rows without a label, an id or a text aren't used.
    """
    known = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known if may_learn is None else known.where(may_learn)
    order = [F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id"]
    ids = [known.where(F.col("toxic") == y).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(*order).limit(n) for y, n in SAMPLE.items()]
    picked = F.broadcast(ids[0].unionByName(ids[1]))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(picked, "doc_id").where("text is not null")
    got = sorted((r.doc_id, r.text, r.toxic) for r in rows.toLocalIterator())
    counts = {r.toxic: r["count"] for r in known.where("toxic in (0, 1)").groupBy("toxic").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    return fit([t for _, t, _ in got], [y for *_, y in got], share if 0 < share < 1 else None)


class Scorer:
    """Scores texts in a worker."""

    def __init__(self, model: Model):
        self.model, self.features = model, Features(model)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, list[int]]:
        told = [self.features(t.lower().split() if t else []) for t in texts]
        return (self.model.score(np.array([x for x, _ in told])) if told else np.zeros(0)), [n for _, n in told]


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            yield b.slice(i, ROWS)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, n_hits) of every whole text; null and empty texts are scored as texts without a word; repeated rows are scored alike; an empty table gives no rows. Other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in _sliced(batches):
            s, n = scorer(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array(n, pa.int32())], ["doc_id", "score", "n_hits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(c.lean(run), "doc_id long, score double, n_hits int")


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, all columns, whose score is below the threshold; the texts never leave their tasks."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in _sliced(batches):
            s, _ = scorer(b.column(at).to_pylist())
            yield b.filter(pa.array(s < threshold))

    return docs.mapInArrow(c.lean(run), docs.schema)
