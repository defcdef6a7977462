"""Embeddings, fuzzy spans, similarity blocks and calibration against plain computations."""

from __future__ import annotations

import hashlib
import math
import random
import re
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapengine.functions import udfs
from gapengine.operators import calibration, clustering, pivots, similarity


def slow_embedding(text, size):
    words = [w.casefold() for w in re.findall(r"[^\W_]+(?:['’-][^\W_]+)?", text)]
    grams = [("w:" + "\x1f".join(words[i : i + n]), 1 / math.sqrt(n)) for n in (1, 2) for i in range(len(words) - n + 1)]
    grams += [(f"c{n}:" + f"^{w}$"[i : i + n], 0.35 / math.sqrt(n)) for w in words for n in (3, 4) for i in range(len(w) + 3 - n)]
    out = np.zeros(size)
    for g, weight in grams:
        raw = int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "little")
        out[raw % size] += -weight if raw >> 63 else weight
    return out / (np.linalg.norm(out) or 1)


def test_embedding(spark):
    texts = ["Crash on start", "", None, "it's a well-known Straße bug", "x", "crash crash crash on on start"]
    got = [r.v for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", udfs.hash_embed(F.col("t"), 64).alias("v")).orderBy("i").collect()]
    assert np.allclose(got, [slow_embedding(t or "", 64) for t in texts], atol=1e-6)
    assert np.allclose(udfs.embed(texts[0]), slow_embedding(texts[0], 768), atol=1e-6)
    with pytest.raises(ValueError):
        udfs.Embedder(16)


def slow_span(quote, source):
    want, best = " ".join(quote.split()).casefold(), (0.0, 0, 0)
    spans = [m.span() for m in re.finditer(r"\S+", source)]
    n = len(quote.split())
    for i in range(len(spans)):
        for j in range(i, len(spans)):
            if abs(j - i + 1 - n) <= 2:
                a, b = spans[i][0], spans[j][1]
                r = SequenceMatcher(None, want, " ".join(source[a:b].split()).casefold()).ratio()
                if r:
                    best = min(best, (-r, a, b))
    return -best[0], best[1], best[2]


def test_fuzzy_spans():
    r = random.Random(2)
    words = "the app crashes when I open my drafts and lose every word again today".split()
    for _ in range(60):
        source = " ".join(r.choice(words) for _ in range(r.randint(1, 25))) + r.choice(["", ".", "  end "])
        quote = " ".join(w if r.random() < 0.8 else w[::-1] for w in source.split()[r.randint(0, 3) :][: r.randint(1, 8)]) or "x"
        score, a, b = slow_span(quote, source)
        got = udfs.best_span(quote, source, 0.0001)
        assert got[1] == round(score, 6) and (not score or got[2:] == (a, b, source[a:b]))
    assert udfs.best_span("nothing alike", "zzz", 0.9) == (False, 0.0, -1, -1, None) or not udfs.best_span("nothing alike", "zzz", 0.9)[0]
    for q, s in ((None, "x"), ("", "x"), ("  ", "x"), ("x", None), ("x", "")):
        assert udfs.best_span(q, s, 0.5) == (False, 0.0, -1, -1, None)


def test_similarity_in_blocks_equals_one_matrix(spark, monkeypatch):
    r = np.random.default_rng(4)
    v = r.normal(size=(70, 8))
    v[5] = v[9]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(unit @ unit.T, 12)
    pairs = {(i, j) for i in range(70) for j in range(i + 1, 70) if s[i, j] >= 0.5}
    for block in (4096, 16):
        monkeypatch.setattr(pivots, "BLOCK", block)
        top = {(x.query_id, x["rank"]): x.item_id for x in similarity.top_k(rows, rows, 3, "id", "id", "v", "v").collect()}
        assert top == {(i, k + 1): int(j) for i in range(70) for k, j in enumerate(np.lexsort((np.arange(70), -s[i]))[:3])}
        assert {(x.a, x.b) for x in similarity.redundant_pairs(rows, 0.5, "id", "v").collect()} == pairs
        assert similarity.top_k(rows, rows.limit(0), 3, "id", "id", "v", "v").isEmpty()


def test_greedy_clusters():
    v = np.array([[1, 0], [0.99, 0.1], [0, 1], [0.1, 0.99], [-1, 0]], float)
    assert clustering.greedy_labels(v / np.linalg.norm(v, axis=1, keepdims=True), 0.9).tolist() == [0, 0, 1, 1, 2]


def rows_of(spark, data):
    return spark.createDataFrame([(i, float(s), float(y)) for i, (s, y) in enumerate(data)], "id long, score double, y double")


def test_platt_of_separate_shares(spark):
    # two scores with shares of 0.25 and 0.75: the fitted curve goes through both
    data = rows_of(spark, [(0.0, y) for y in (1, 0, 0, 0)] * 5 + [(1.0, y) for y in (1, 1, 1, 0)] * 5)
    got = {round(r.score): r.p for r in calibration.fit(data, "platt").apply(data).collect()}
    assert got[0] == pytest.approx(0.25, abs=1e-3) and got[1] == pytest.approx(0.75, abs=1e-3)


def test_isotonic_pools_violators(spark):
    data = rows_of(spark, [(0.1, 0), (0.2, 1), (0.3, 0), (0.4, 1)])
    got = [r.p for r in calibration.fit(data, "isotonic").apply(data).orderBy("score").collect()]
    assert got == pytest.approx([0, 0.5, 0.5, 1])


def test_calibration_of_one_class_and_cross_fitting(spark):
    one = rows_of(spark, [(0.2, 1), (0.7, 1)])
    assert [r.p for r in calibration.fit(one).apply(one).collect()] == [1.0, 1.0]
    assert [r.p for r in calibration.fit(one, "identity").apply(one).orderBy("score").collect()] == [0.2, 0.7]
    r = random.Random(1)
    data = rows_of(spark, [(s := r.random(), r.random() < s) for _ in range(60)])
    got = calibration.cross_fitted(data, "id").collect()
    assert len(got) == 60 and {x.fold for x in got} == set(range(5)) and all(0 < x.p < 1 for x in got)


def test_embedding_by_an_own_model(spark):
    got = [r.v for r in spark.createDataFrame([("abc",), (None,)], "t string").select(udfs.model_embed(F.col("t"), lambda: lambda texts: np.array([[len(t), 4.0 * (len(t) > 0)] for t in texts])).alias("v")).collect()]
    assert np.allclose(got, [[0.6, 0.8], [0, 0]])


def test_model_client(tmp_path):
    from gapengine.sources.model import Client, stub

    schema = {"type": "object", "properties": {"verdict": {"enum": ["a", "b"]}, "n": {"type": "integer"}, "ids": {"type": "array"}}}
    assert Client().ask("p", schema) == stub(schema) == {"verdict": "a", "n": 0, "ids": []}
    said, waits = iter([RuntimeError("busy"), {"n": 1}, {"n": 2}]), []

    def transport(prompt, schema):
        x = next(said)
        if isinstance(x, Exception):
            raise x
        return x

    client = Client(transport, tmp_path, wait=waits.append, clock=lambda: 0.0)
    assert [client.ask("p", schema), client.ask("p", schema), client.ask("p", schema, sample=1)] == [{"n": 1}, {"n": 1}, {"n": 2}]
    assert (client.calls, client.failures, waits) == (3, 1, [1.0])
    with pytest.raises(StopIteration):
        Client(transport, retries=0).ask("q", schema)


def test_embedding_takes_bounded_pieces(spark):
    """Rows of one batch are embedded by so many characters at a time (before: 256 rows, however long) and stay in order."""
    long = ["a" * udfs.CHARACTERS, "b" * (udfs.CHARACTERS // 2)]
    assert [len(p) for p in udfs.pieces([long[0], None, long[1], long[1], "c", *[""] * 300])] == [2, 2, 256, 45]
    assert list(udfs.pieces([])) == []
    texts = [f"word{i % 7} other{i}" for i in range(600)]
    got = [r.v for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1).select("i", udfs.hash_embed(F.col("t"), 64).alias("v")).orderBy("i").collect()]
    assert np.allclose(got, [udfs.embed(t, 64) for t in texts], atol=1e-6)
