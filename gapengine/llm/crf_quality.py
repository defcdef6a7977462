"""Quality rules by line labels: a linear-chain conditional random field, decoded by Viterbi, marks lines as content or boilerplate.

The chain is fitted on a bounded sample of labelled documents (lines of good ones count as content, of bad ones as boilerplate). A
document is kept if it passes two base rules and at least SHARE of its words stand in content lines. Counts are taken from whole texts by array operations over chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapengine.llm import common as c

#: Bounds of the training sample: documents of each label, those with the least md5 of doc_id. In the fit, a document of more than LINES lines is several sequences.
SAMPLE, LINES = {1: 1500, 0: 1500}, 200
SHARE = 0.5
MIN_WORDS, MAX_REPEATED = 10, 20
N_FEATURES = 15

_SPACE = np.zeros(256, np.uint8)
_SPACE[[32, *range(9, 14)]] = 1
_CLASSES = np.zeros((7, 256), np.float32)
for _k, _set in enumerate((b"#*$%&|<>", b"|", b"!", bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b".?:;")):
    _CLASSES[_k][list(_set)] = 1


class Chunk:
    """Counts of the documents of one chunk and of their lines."""

    def __init__(self, texts: list[bytes | None]):
        n = len(texts)
        data = np.frombuffer(b"\n".join(t or b"" for t in texts) + b"\n", np.uint8)
        ends = np.cumsum([len(t or b"") + 1 for t in texts])
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        space = _SPACE[data]
        first = (space == 0) & (np.concatenate([[1], space[:-1]]) == 1)  # where a word begins
        breaks = np.flatnonzero(data == 10)
        line = np.concatenate([[0], breaks[:-1] + 1]).astype(np.int64)
        self.line_doc = np.searchsorted(ends, line, "right")
        add = lambda x, at: np.add.reduceat(x, at) if len(at) else np.zeros(0)
        self.line_words = add(first.astype(np.int64), line)
        letters = ((data & 0xC0) != 0x80) & (space == 0)  # code points within words
        self.word_chars = add(letters.astype(np.int64), starts)
        self.n_symbols = add(_CLASSES[0][data].astype(np.int64), starts)
        self.n_words = np.bincount(self.line_doc, self.line_words, n).astype(np.int64)
        counts = [add(k[data], line) for k in _CLASSES]
        chars = add(letters.astype(np.float32), line)
        self._repeats(texts, n)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(x) for t in texts for x in (t or b"").split(b"\n")), np.uint64, len(line))
        order = np.lexsort((np.arange(len(line)), hashes, self.line_doc))
        h, d = hashes[order], self.line_doc[order]
        again = np.zeros(len(line), bool)
        again[order[1:]] = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
        again &= self.line_words > 0
        self.n_dup_lines = np.bincount(self.line_doc, again, n).astype(np.int64)
        w, upper, lower = np.maximum(self.line_words, 1), counts[3], counts[4]
        last = np.maximum(breaks - 1, line)
        covered = add(self.covered_at(first, data).astype(np.float32), line)
        f = [
            np.ones(len(line)), self.line_words <= 2, (self.line_words > 2) & (self.line_words < 10), self.line_words >= 30,
            np.minimum(counts[0] / w, 3), np.minimum(counts[1] / w, 1), np.minimum(counts[2] / w, 3), (upper > lower) * 1.0,
            np.minimum(counts[5] / np.maximum(chars, 1), 1), again, covered / w, np.isin(data[last], list(b".?!")), chars / w > 12, counts[6] / w, np.log1p(self.line_words),
        ]
        self.used = self.line_words > 0  # blank lines take no part in the chain
        self.features = np.stack([np.asarray(x, np.float32) for x in f], 1)

    def _repeats(self, texts: list[bytes | None], n: int) -> None:
        tokens = [t.split() if t else [] for t in texts]
        doc = np.repeat(np.arange(n), [len(t) for t in tokens])
        h, at = c.windows(c.hashed([w for t in tokens for w in t]), doc)
        key = c.mixed(h ^ (doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) if len(h) else h
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        edge = np.zeros(len(doc) + 1, np.int64)
        np.add.at(edge, at[twice], 1)
        np.add.at(edge, at[twice] + c.SHINGLE, -1)
        self.covered = np.cumsum(edge[:-1]) > 0 if len(doc) else np.zeros(0, bool)
        self.n_repeat_words = np.bincount(doc, self.covered, n).astype(np.int64) if len(doc) else np.zeros(n, np.int64)

    def covered_at(self, first: np.ndarray, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data), bool)
        out[np.flatnonzero(first)[: len(self.covered)]] = self.covered
        return out


class Chain:
    """Two labels, 1 for content: weights by feature, and of one label after another."""

    def __init__(self, emit: np.ndarray | None = None, trans: np.ndarray | None = None):
        self.emit = np.zeros((N_FEATURES, 2)) if emit is None else emit
        self.trans = np.zeros((2, 2)) if trans is None else trans

    def viterbi(self, features: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The best labels of all sequences, which stand one after another; the steps are shared by those that are long enough. Ties go to label 1."""
        score = features @ self.emit
        out = np.ones(len(features), np.int8)
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        if not len(length) or not length[0]:
            return out
        back = np.zeros((len(features), 2), np.int8)
        live = int((length > 0).sum())
        v = score[start[:live]].copy()
        last = np.zeros(len(length), np.int8)
        for k in range(1, int(length[0]) + 1):
            now = int(np.searchsorted(-length, -k, "left"))  # sequences longer than k
            last[now:live] = (v[now:live, 1] >= v[now:live, 0]).astype(np.int8)
            if not now:
                break
            v = v[:now]
            step = v[:, :, None] + self.trans
            pick = (step[:, 1, :] >= step[:, 0, :]).astype(np.int8)
            back[start[:now] + k] = pick
            v = np.where(pick == 1, step[:, 1, :], step[:, 0, :]) + score[start[:now] + k]
            live = now
        label = last[: len(length)]
        for k in range(int(length[0]) - 1, -1, -1):
            now = int(np.searchsorted(-length, -k, "left"))
            at = start[:now] + k
            out[at] = label[:now]
            label[:now] = back[at, label[:now]]
        return out

    def gradient(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Mean log-likelihood of padded sequences (n, steps, features) and its gradients, by forward and backward sums."""
        n, steps, _ = x.shape
        score = x @ self.emit
        lse = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
        alpha, beta = np.zeros((n, steps, 2)), np.zeros((n, steps, 2))
        alpha[:, 0] = score[:, 0]
        for t in range(1, steps):
            nxt = lse(alpha[:, t - 1, :, None] + self.trans, 1) + score[:, t]
            alpha[:, t] = np.where(mask[:, t, None], nxt, alpha[:, t - 1])
        for t in range(steps - 2, -1, -1):
            prev = lse(self.trans + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1, None], prev, beta[:, t + 1])
        z = lse(alpha[:, -1], 1)
        p = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        want = np.eye(2)[y] * mask[..., None]
        emit = np.einsum("ntf,ntk->fk", x, want - p)
        both = mask[:, 1:] & mask[:, :-1]
        pair = np.exp(alpha[:, :-1, :, None] + self.trans + (score[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[..., None, None]
        seen = (want[:, :-1, :, None] * want[:, 1:, None, :]) * both[..., None, None]
        like = (score * want).sum() + (self.trans * seen.sum((0, 1))).sum() - z.sum()
        return like / n, emit / n, (seen - pair).sum((0, 1)) / n

    def fit(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, steps: int = 200, rate: float = 0.1, ridge: float = 1e-3) -> Chain:
        """Adam ascent on the penalised likelihood, from zero."""
        params = [self.emit, self.trans]
        m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for t in range(1, steps + 1):
            _, *grads = self.gradient(x, y, mask)
            for k, (p, g) in enumerate(zip(params, grads, strict=True)):
                g = g - ridge * p
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                p += rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
        return self


def _lines(chunk: Chunk, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of lines with words, their words, and each document's first such line and number of them."""
    used = chunk.used
    length = np.bincount(chunk.line_doc[used], minlength=n)
    return chunk.features[used], chunk.line_words[used], np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64), length


def train(docs: DataFrame, labels: DataFrame) -> Chain:
    """Fits on at most SAMPLE labelled rows; labels(doc_id, quality). Without both classes every line is content."""
    known = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    ids = [known.where(F.col("quality") == q).groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(n) for q, n in SAMPLE.items()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id").where("text is not null")
    got = sorted((r.doc_id, r.text.encode(), r.quality) for r in rows.toLocalIterator())
    return fitted([t for _, t, _ in got], [q for *_, q in got])


def fitted(texts: list[bytes], quality: list[int]) -> Chain:
    picked, y = [], []
    for i in range(0, len(texts), 256):
        part = texts[i : i + 256]
        f, _, start, length = _lines(Chunk(part), len(part))
        for k, (s, n) in enumerate(zip(start.tolist(), length.tolist(), strict=True)):
            for at in range(s, s + n, LINES):
                picked.append(f[at : min(at + LINES, s + n)])
                y.append(quality[i + k])
    chain = Chain()
    if len(set(y)) < 2:
        chain.emit[0, 1] = 1.0
        return chain
    steps = max(map(len, picked))
    x, mask = np.zeros((len(picked), steps, N_FEATURES), np.float32), np.zeros((len(picked), steps), bool)
    for k, f in enumerate(picked):
        x[k, : len(f)], mask[k, : len(f)] = f, True
    order = np.argsort([len(f) for f in picked])  # short chains need no long padding
    lab = np.repeat(np.array(y)[:, None], steps, 1)
    groups = [g for g in np.array_split(order, 8) if len(g)]
    parts = [(x[g][:, : mask[g].sum(1).max()], lab[g][:, : mask[g].sum(1).max()], mask[g][:, : mask[g].sum(1).max()]) for g in groups]
    whole = Chain.gradient

    def mean(self, *_):
        out = [whole(self, *p) for p in parts]
        w = np.array([len(p[0]) for p in parts]) / len(picked)
        return tuple(sum(a * o[k] for a, o in zip(w, out, strict=True)) for k in range(3))

    grouped = type("Grouped", (Chain,), {"gradient": mean})()
    grouped.fit(x, lab, mask)
    return Chain(grouped.emit, grouped.trans)


def judge(texts: list[bytes | None], chain: Chain) -> dict[str, np.ndarray]:
    """The counts and the verdict of each text."""
    n = len(texts)
    k = Chunk(texts)
    f, words, start, length = _lines(k, n)
    labels = chain.viterbi(f, start, length)
    content = np.bincount(np.repeat(np.arange(n), length), words * (labels == 1), n)
    failed = (k.n_words < MIN_WORDS) | (100 * k.n_repeat_words > MAX_REPEATED * k.n_words)
    share = content / np.maximum(k.n_words, 1)
    return {"n_words": k.n_words, "word_chars": k.word_chars, "n_symbols": k.n_symbols, "n_dup_lines": k.n_dup_lines, "n_repeat_words": k.n_repeat_words, "base_failed": failed, "kept": ~failed & (share >= SHARE), "content_share": share}


_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def verdicts(docs: DataFrame, chain: Chain) -> DataFrame:
    """A row for each document. Null and empty texts have no words, fail the base rules and aren't kept; a null doc_id is passed on; repeated rows are judged alike; an empty table gives no rows. Other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = c.raw(b)
            for i, j in c.chunks(texts):
                out = judge(texts[i:j], chain)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *map(pa.array, out.values())], ["doc_id", *out])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(c.lean(run), _SCHEMA)
