"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming lookup, exact weighted-shingle check.

Texts and items are lower-cased (A-Z), freed of ASCII punctuation and split into words. A window of as many words as an item can
only be similar to it if they share a 5-word shingle, so the windows that hold a shingle of an item are fingerprinted, and no
others; a document of fewer words than the item is one window as a whole. Fingerprints have 128 bits in 16 blocks of 8: two of them within RADIUS = 31 bits differ by at most one bit in some block, so
looking up each block and its one-bit neighbours finds every item within the radius. What is found is verified exactly: weighted
Jaccard of the shingles (weight: ln(1 + items / items that hold it)) of at least 0.8. Weights are counted over all items, so the blocks
in which items are looked for don't change what is found.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapengine.llm import common as c

RADIUS, BITS, BLOCK = 31, 128, 8
#: Items that one pass over the documents looks for; more items take more passes, so what a task is sent is bounded.
ITEMS = 4096
#: No more text of items than so many bytes in one block, except that a longer item makes a block of its own.
ITEM_BYTES = 4 << 20
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def words(text: bytes | None) -> list[bytes]:
    return text.translate(None, PUNCTUATION).lower().split() if text else []


def _bits(h: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 128 bits of a shingle."""
    both = np.stack([c.mixed(h ^ np.uint64(0x5851F42D4C957F2D)), c.mixed(h ^ np.uint64(0x14057B7EF767814F))], 1)
    return np.unpackbits(both.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def item_shingles(tokens: list[bytes]) -> np.ndarray:
    """Hashes of the shingles of one text, in order; of fewer than five words, none."""
    return c.windows(c.hashed(tokens), np.zeros(len(tokens), np.int64))[0]


@dataclass
class Weights:
    """The number of all items, and the shingles that more than one of them holds: sorted hashes and numbers of holders. All others, unknown ones too, weigh as if one item held them."""

    items: int
    keys: np.ndarray
    holders: np.ndarray

    @staticmethod
    def of(texts: list[bytes]) -> Weights:
        held = Counter(x for t in texts for x in set(item_shingles(words(t)).tolist()))
        shared = sorted((x, n) for x, n in held.items() if n > 1)
        return Weights(len(texts), np.array([x for x, _ in shared], np.uint64), np.array([n for _, n in shared], np.int64))

    def __call__(self, h: np.ndarray) -> np.ndarray:
        n = np.ones(len(h), np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            n = np.where(self.keys[at] == h, self.holders[at], n)
        return np.log1p(max(1, self.items) / n)


class Index:
    """Items by length, by shingle and by fingerprint block. weights: those of all items, if these are only a part of them."""

    def __init__(self, items: list[tuple[int, bytes]], similarity: float = 0.8, weights: Weights | None = None):
        self.similarity = similarity
        self.weigh = Weights.of([t for _, t in items]) if weights is None else weights
        self.ids = [i for i, _ in items]
        tokens = [words(t) for _, t in items]
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.bags: list[Counter] = []
        self.short: dict[tuple[bytes, ...], list[int]] = defaultdict(list)
        holders: dict[int, list[int]] = defaultdict(list)
        for k, t in enumerate(tokens):
            if len(t) < c.SHINGLE:
                if t:
                    self.short[tuple(t)].append(k)
                self.bags.append(Counter())
                continue
            h = item_shingles(t)
            self.bags.append(Counter(h.tolist()))
            for x in set(h.tolist()):
                holders[x].append(k)
        self.holders = dict(holders)
        self.keys = np.array(sorted(self.holders), np.uint64)
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.weights = dict(zip(self.keys.tolist(), self.weigh(self.keys).tolist(), strict=True))
        self.prints = np.array([self.fingerprint(b) for b in self.bags], np.uint8).reshape(len(items), BITS // 8)
        self.blocks: list[dict[int, list[int]]] = [defaultdict(list) for _ in range(BITS // BLOCK)]
        for k, p in enumerate(self.prints):
            for block, value in enumerate(p.tolist()):
                for near in (value, *(value ^ (1 << bit) for bit in range(BLOCK))):
                    self.blocks[block][near].append(k)

    def fingerprint(self, bag: Counter) -> np.ndarray:
        if not bag:
            return np.zeros(BITS // 8, np.uint8)
        keys = np.array(list(bag), np.uint64)
        return np.packbits((self.weigh(keys) * np.array(list(bag.values()))) @ _bits(keys) > 0)

    def near(self, fingerprint: np.ndarray) -> list[int]:
        """Every item whose fingerprint is within RADIUS."""
        found = sorted(set().union(*(self.blocks[b].get(v, ()) for b, v in enumerate(fingerprint.tolist()))))
        if not found:
            return []
        distance = np.unpackbits(self.prints[found] ^ fingerprint, axis=1).sum(1)
        return [k for k, d in zip(found, distance.tolist(), strict=True) if d <= RADIUS]

    def similar(self, bag: Counter, item: int, weights: dict[int, float]) -> float:
        """weights: of the shingles of the bag."""
        other = self.bags[item]
        both = sum(weights[x] * min(n, other[x]) for x, n in bag.items() if x in other)
        total = sum(weights[x] * n for x, n in bag.items()) + sum(self.weights[x] * n for x, n in other.items()) - both
        return both / total if total else 0.0

    def short_in(self, tokens: list[bytes]) -> list[tuple[int, int]]:
        """(item, start) of the items of fewer than five words whose words stand in this order in a text; the first place of each."""
        sizes, begins = {len(k) for k in self.short}, {k[0] for k in self.short}
        found: dict[int, int] = {}
        for at, w in enumerate(tokens):
            if w in begins:
                for n in sizes:
                    for k in self.short.get(tuple(tokens[at : at + n]), ()) if at + n <= len(tokens) else ():
                        found.setdefault(k, at)
        return sorted(found.items())

    def search(self, h: np.ndarray) -> dict[int, tuple[int, float]]:
        """From the shingle hashes of one document: the first best window of each item that is found."""
        at = np.flatnonzero(self.sieve[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = at[np.isin(h[at], self.keys)] if len(at) else at
        most = len(h) + c.SHINGLE - 1  # a document shorter than an item is one window
        starts: dict[int, set[int]] = defaultdict(set)
        for p in at.tolist():
            for n in {min(int(self.length[k]), most) for k in self.holders[int(h[p])]}:
                starts[n].update(range(max(0, p - n + c.SHINGLE), min(p, len(h) - (n - c.SHINGLE) - 1) + 1))
        best: dict[int, tuple[int, float]] = {}
        for n, found in starts.items():
            wide = n - c.SHINGLE + 1
            first = np.array(sorted(found), np.int64)
            for part in np.split(first, np.flatnonzero(np.diff(first) > wide) + 1):
                if not len(part):
                    continue
                for i in range(0, len(part), 2048):
                    own = part[i : i + 2048]
                    lo, hi = int(own[0]), int(own[-1]) + wide
                    span = h[lo:hi]
                    weights = self.weigh(span)
                    by_shingle = dict(zip(span.tolist(), weights.tolist(), strict=True))
                    sums = np.vstack([np.zeros(BITS), np.cumsum(_bits(span) * weights[:, None], 0)])
                    prints = np.packbits(sums[own - lo + wide] - sums[own - lo] > 1e-9, axis=1)
                    seen: dict[bytes, list[int]] = {}
                    for s, f in zip(own.tolist(), prints, strict=True):
                        if (key := f.tobytes()) not in seen:
                            seen[key] = self.near(f)
                        if seen[key]:
                            bag = Counter(h[s : s + wide].tolist())
                            for k in seen[key]:
                                if min(int(self.length[k]), most) == n and (x := self.similar(bag, k, by_shingle)) >= self.similarity and x > best.get(k, (0, 0.0))[1]:
                                    best[k] = (s, x)
        return best


def batch_leaks(texts: list[bytes | None], index: Index) -> list[tuple[int, int, int, float]]:
    """(row, item, start, similarity) of a batch's texts."""
    out = []
    for i, j in c.chunks(texts):
        tokens = [words(t) for t in texts[i:j]]
        lengths = np.fromiter(map(len, tokens), np.int64, j - i)
        doc = np.repeat(np.arange(j - i), lengths)
        if index.short:
            out += [(i + r, k, at, 1.0) for r, t in enumerate(tokens) for k, at in index.short_in(t)]
        h, at = c.windows(c.hashed([w for t in tokens for w in t]), doc)
        if not len(h):
            continue
        docs = doc[at]
        hit = index.sieve[(h & np.uint64((1 << 20) - 1)).astype(np.int64)]
        hit[hit] = np.isin(h[hit], index.keys)
        for r in np.unique(docs[hit]).tolist():
            lo, hi = np.searchsorted(docs, [r, r + 1])
            out += [(i + r, k, s, x) for k, (s, x) in index.search(h[lo:hi]).items()]
    return out


def distinct_items(benchmark: DataFrame) -> DataFrame:
    """The distinct items; rows without an id or a text are left out."""
    return benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct shingles of each item, and a null for the item itself."""
    for b in batches:
        for t in c.raw(b):
            h = np.unique(item_shingles(words(t)))
            yield pa.RecordBatch.from_arrays([pa.array([None, *h.view(np.int64).tolist()], pa.int64())], ["shingle"])


def weights(benchmark: DataFrame) -> Weights:
    """Counted over all items. Only shingles that several items hold come to the driver, 16 bytes each."""
    found = distinct_items(benchmark).mapInArrow(c.lean(counted), "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1 or shingle is null")
    keys, n, items = [], [], 0
    for b in found.toArrow().to_batches():
        null = b.column(0).is_null().to_numpy(zero_copy_only=False)
        count = b.column(1).to_numpy()
        items += int(count[null].sum())
        keys.append(b.column(0).filter(pa.array(~null)).to_numpy().view(np.uint64)), n.append(count[~null])
    key = np.concatenate([np.zeros(0, np.uint64), *keys])
    order = np.argsort(key)
    return Weights(items, key[order], np.concatenate([np.zeros(0, np.int64), *n])[order])


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """The distinct items in blocks of bounded size, in order of their ids."""
    rows = distinct_items(benchmark).orderBy("item_id", "text")
    held, size = [], 0
    for r in rows.toLocalIterator():
        text = r.text.encode()
        if held and (len(held) >= ITEMS or size + len(text) > ITEM_BYTES):
            yield held
            held, size = [], 0
        held.append((r.item_id, text))
        size += len(text)
    if held:
        yield held


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(doc_id, item_id, start, similarity): a row for each document and benchmark item that a window of it repeats; start counts words.

    Items of fewer than five words, which have no shingle to be like, are found where their words stand in this order. Null and empty texts hold nothing; a null doc_id is kept;
    repeated rows give repeated results; without items or documents there are no rows. Other columns are ignored.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, start long, similarity double"
    out, all_weights = None, docs.sparkSession.sparkContext.broadcast(weights(benchmark))
    for items in blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            index = Index(items, similarity, all_weights.value)
            for b in batches:
                found = batch_leaks(c.raw(b), index)
                rows = pa.array([x[0] for x in found], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), pa.array([index.ids[x[1]] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64()), pa.array([x[3] for x in found], pa.float64())], ["doc_id", "item_id", "start", "similarity"])

        part = plain.mapInArrow(c.lean(run), schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The rows, all columns, that repeat no benchmark item; the texts never leave their tasks. Null and empty texts repeat nothing and stay.

    A few words in a row prove nothing: for an item of fewer than five words only a document that is that item, word for word, goes.
    """
    at, all_weights = docs.columns.index("text"), docs.sparkSession.sparkContext.broadcast(weights(benchmark))
    for items in blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            index = Index(items, similarity, all_weights.value)
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                texts = b.column(at).cast(pa.binary()).to_pylist()
                found = batch_leaks(texts, index)
                keep[[r for r, k, *_ in found if index.length[k] >= c.SHINGLE or len(words(texts[r])) == index.length[k]]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(c.lean(run), docs.schema)
    return docs
