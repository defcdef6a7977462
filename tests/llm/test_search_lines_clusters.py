"""Tiered search, line runs and ball k-means against brute force, SQL and their own laws."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gapengine.llm import ball_kmeans, common, line_runs, queries, tiered_search

SF = "/root/testdata/sf0.01"


def sql(name, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    return [d[0] for d in found.description], found.fetchall()


@pytest.mark.parametrize(("name", "tables"), [("op11_tiered_search", ["documents", "benchmark"]), ("op12_line_runs", ["documents"]), ("op13_ball_kmeans", ["embeddings"])])
def test_queries_equal_their_sql(spark, name, tables):
    columns, want = sql(name, tables)
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r[x] for x in columns) for r in got.collect()))) == sorted(map(repr, want))


# tiered search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def best_of(docs, items, top=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    full = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, length, df = len(full), sum(n for *_, n in full), Counter(x for _, b, _ in full for x in b)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(terms(t))
    out = []
    for item, asked in wanted.items():
        scores = []
        for doc, bag, n in full:
            m = 100 - 90 + 90 * n * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (1000000000 * bag[x] // (1000 * bag[x] + 8 * m)) for x in asked if x in bag)
            scores += [(-score, doc is None, doc or 0, doc)] if score > 0 else []
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


def corpus(seed, n):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(300)] + ["Émile", "ÀB", "naïve"]
    pick = lambda: words[min(int(r.paretovariate(0.6)) - 1, len(words) - 1)]
    docs = [(i, " ".join(pick() for _ in range(r.choice([0, 1, 3, 20, 60])))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "...,;"), (None, "w250 w251 w1"), (7, docs[7][1]), *[(n + 10 + k, "w40 w41 w42 w43") for k in range(25)]]
    items = [(k, " ".join(pick() for _ in range(12))) for k in range(15)] + [(100, None), (101, "--"), (None, "w0 w1 w250"), (3, "w200 w201"), (102, "w40 w41 w42 w43"), (103, "unheard of"), (104, "w0"), (104, "w0")]
    return docs, items


@pytest.mark.parametrize(("seed", "first", "grow", "block"), [(2, 12, 2, 200_000), (3, 20, 3, 120)])
def test_search_equals_brute_force(spark, seed, first, grow, block):
    docs, items = corpus(seed, 250)
    got = tiered_search.ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), first=first, grow=grow, block=block).collect()
    assert sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in got), key=repr) == best_of(docs, items)
    if first == 12:
        assert min(r.tiers for r in got) == 1 and max(r.tiers for r in got) > 2  # some items are proven at once, others fall through


def test_an_item_that_is_proven_reads_no_lower_tier(spark):
    docs = [(i, f"common filler{i % 50} " + ("needle pin " if i < 12 else "")) for i in range(600)]
    got = tiered_search.ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, "needle pin common"), (2, "common")], "item_id long, text string"), first=16, grow=2).collect()
    assert {r.tiers for r in got if r.item_id == 1} == {1} and [r.doc_id for r in got if r.item_id == 1] == list(range(10))


def test_search_of_empty_tables_and_clashing_names(spark):
    docs, items = corpus(4, 60)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert tiered_search.ranked(d.limit(0), i).count() == tiered_search.ranked(d, i.limit(0)).count() == 0
    for x in ("row", "id", "n", "tf", "term", "impact", "tier", "level", "rank", "score"):
        d, i = d.withColumn(x, F.lit("x")), i.withColumn(x, F.lit("y"))
    assert sorted((tuple(r)[:4] for r in tiered_search.ranked(d, i).collect()), key=repr) == best_of(docs, items)


def test_long_texts_are_counted_in_slices(monkeypatch):
    text = " ".join(f"A{k % 977}" for k in range(50_000)).encode()
    whole = tiered_search.counted(text)
    monkeypatch.setattr(tiered_search, "SLICE", 101)
    assert tiered_search.counted(text) == whole == Counter(text.lower().split())
    assert tiered_search.counted(b"x" * 1000) == {b"x" * 1000: 1}


def test_impacts_in_decimals_equal_those_in_longs(spark):
    rows = [(n, tf) for n in (1, 17, 999, 10**6) for tf in (1, 5, n)]
    df = spark.createDataFrame(rows, "n long, tf long")
    narrow, wide = (tiered_search.impact(F.col("n"), F.col("tf"), 1000, 12345, longest) for longest in (10, 1 << 60))
    got = df.select("n", "tf", narrow.alias("a"), wide.alias("b")).collect()
    assert all(r.a == r.b == 1000000000 * r.tf // (1000 * r.tf + 8 * (10 + 90 * r.n * 1000 // 12345)) for r in got)


# line runs


def kept_lines(docs, least_chars=20, least_docs=3):
    clean = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    where = defaultdict(list)
    low = -(1 << 63)
    rows = [(low if i is None else i, (t or "").split("\n")) for i, t in docs]
    for i, ls in rows:
        for k in {clean(x) for x in ls if len(clean(x)) >= least_chars}:
            where[k].append(i)
    last = {k: max(v) for k, v in where.items() if len(v) >= least_docs}
    out = []
    for (i, _), (own, ls) in zip(docs, rows, strict=True):
        stays = [x for x in ls if last.get(clean(x), own) == own]
        out.append((i, len(ls), len(ls) - len(stays), "\n".join(stays)))
    return sorted(out, key=repr)


def pages(seed, n):
    r = random.Random(seed)
    shared = [f"  Shared LINE number {k} of all \t" for k in range(15)] + ["shared line number 3 of all", "É" * 19, "É" * 20, "short", "", " "]
    docs = [(r.choice([i, i, i, -i]), "\n".join(r.choice([*shared, f"a line that only document {i} has", shared[0]]) for _ in range(r.choice([0, 1, 2, 9])))) for i in range(n)]
    return docs + [(None, shared[0]), (None, "x\n" + shared[1]), (5, docs[5][1]), (n, None), (n + 1, ""), (n + 2, "\n\n"), ((1 << 63) - 1, shared[2] + "\r\n" + shared[2]), (-(1 << 62), shared[2])]


@pytest.mark.parametrize(("batches", "fanout"), [(4, 2), (7, 3)])
def test_line_dedup_equals_brute_force(spark, batches, fanout):
    docs = pages(batches, 150)
    got = line_runs.deduplicated(spark.createDataFrame(docs, "doc_id long, text string"), batches=batches, fanout=fanout).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got), key=repr) == kept_lines(docs)


def test_runs_add_up_in_any_order_and_a_batch_counts_once(spark):
    docs = [(i, t) for i, t in pages(9, 200) if i is not None]
    found = line_runs.lines(line_runs.named(spark.createDataFrame(docs, "doc_id long, text string")))
    want = {(r.h1, r.h2, r.last) for r in found.where("first").groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc").alias("last")).where("n >= 3").collect()}
    assert want
    for order in ([0, 1, 2, 3, 4], [3, 0, 4, 2, 1]):
        runs = line_runs.Runs(spark)
        for b in order:
            runs.add(f"b{b}", found.where(F.pmod("doc", F.lit(5)) == b))
            runs.add(f"b{b}", found.where(F.pmod("doc", F.lit(5)) == b))  # tried again
        assert [len(x) for x in runs.levels] == [1, 0, 1]  # five batches: one run of four and one of one
        assert {tuple(r) for r in runs.repeated().collect()} == want
        runs.release()


def test_a_settled_line_adds_nothing_to_the_runs(spark):
    line = "this line is in every document"
    found = line_runs.lines(line_runs.named(spark.createDataFrame([(i, line) for i in range(40)], "doc_id long, text string")))
    runs = line_runs.Runs(spark, fanout=9)
    runs.add("new", found.where("doc >= 20"))
    runs.add("old", found.where("doc < 20"))
    runs.add("newest", found.where("doc = 39").withColumn("doc", F.lit(99).cast("long")))
    assert [t.count() for t in runs.tables()] == [1, 0, 1] and runs.repeated().first().last == 99
    runs.release()


def test_runs_are_merged_without_a_shuffle(spark):
    found = line_runs.lines(line_runs.named(spark.createDataFrame(pages(2, 50), "doc_id long, text string")))
    runs = line_runs.Runs(spark, fanout=9)
    runs.add("a", found.where("doc > 20"))
    runs.add("b", found.where("doc <= 20"))
    plan = runs.merged()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    runs.release()


def test_line_dedup_of_long_texts_empty_tables_and_names(spark):
    text = "\n".join(f"line number {k % 150_000} of a very long text" for k in range(200_000))
    docs = [(1, text), (2, text), (3, text + "\nand one of my own that stays")]
    got = line_runs.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, len(r.kept)) for r in got) == [(1, 200_000, 200_000, 0), (2, 200_000, 200_000, 0), (3, 200_001, 0, len(docs[2][1]))]
    plain = spark.createDataFrame(pages(3, 40), "doc_id long, text string")
    wide = plain
    for x in ("doc", "mark", "at", "h1", "h2", "last", "lost", "first", "batch"):
        wide = wide.withColumn(x, F.lit("x"))
    out = line_runs.deduplicated(wide)
    assert out.columns[: len(wide.columns)] == wide.columns
    assert sorted(map(repr, out.select("doc_id", "kept").collect())) == sorted(map(repr, line_runs.deduplicated(plain).select("doc_id", "kept").collect()))
    assert line_runs.deduplicated(plain.limit(0)).count() == 0
    with pytest.raises(ValueError):
        line_runs.deduplicated(plain.withColumn("kept", F.lit(1)))


def test_line_dedup_runs_no_python(spark):
    out = queries.op12_line_runs(spark, SF)
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())
    common.release(out)


# ball k-means


def plain_kmeans(rows, k=8, rounds=10, dims=64):
    good = [(i, e) for i, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    x = np.array([[math.floor(1024 * float(np.float32(v))) for v in e] for _, e in good], dtype=np.int64).reshape(-1, dims)
    h = lambda i: (good[i][0] is None, hashlib.sha256(f"3:{good[i][0]}".encode()).hexdigest(), x[i].tolist())
    at = x[sorted(range(len(good)), key=h)[:k]]
    if not len(good):
        return []
    for r in range(rounds + 1):
        d = ((x[:, None] - at[None]) ** 2).sum(2)
        own = d.argmin(1)
        if r < rounds:
            at = np.array([x[own == j].sum(0) // (own == j).sum() if (own == j).any() else at[j] for j in range(len(at))])
    d = d.min(1)
    return sorted(((i, int(j), int(e), int(d[own == j].sum()), int(d.sum()), hashlib.sha256(",".join(map(str, at[j].tolist())).encode()).hexdigest()) for (i, _), j, e in zip(good, own, d, strict=True)), key=repr)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_ball_kmeans_equals_plain_kmeans_with_fewer_distances(spark):
    r = np.random.default_rng(5)
    centres = r.normal(0, 4, (6, 64))
    rows = [(i, (centres[i % 6] + r.normal(0, 0.4, 64)).astype(np.float32).tolist()) for i in range(500)]
    trace = []
    got = ball_kmeans.clustered(vectors(spark, rows), trace=trace)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_kmeans(rows)
    assert trace[0]["compared"] == trace[0]["all"] and trace[-1]["compared"] < 0.5 * trace[-1]["all"]
    common.release(got)


def test_ball_kmeans_with_odd_rows_and_ties(spark):
    r = np.random.default_rng(6)
    rows = [(i, (r.integers(-2, 3, 64) / 8).astype(np.float32).tolist()) for i in range(60)]
    rows += [(100, [0.5] * 64)] * 4 + [(101, None), (102, []), (103, [1.0] * 63), (104, [1.0] * 65), (105, [None] + [1.0] * 63), (106, [float("nan")] * 64), (107, [float("inf")] + [0.0] * 63), (108, [float("-inf")] + [0.0] * 63), (None, [0.25] * 64), (None, [-0.25] * 64)]
    wide = vectors(spark, rows)
    for x in ("v", "cluster", "distance", "n", "sums", "part", "h"):
        wide = wide.withColumn(x, F.lit("x"))
    assert sorted(map(tuple, ball_kmeans.clustered(wide).collect()), key=repr) == plain_kmeans(rows)
    same = [(i, [0.125] * 64) for i in range(20)]  # all centroids are one point: the first takes all, the others stay empty
    got = ball_kmeans.clustered(vectors(spark, same)).collect()
    assert sorted(map(tuple, got), key=repr) == plain_kmeans(same) and {x.cluster for x in got} == {0}
    few = [(i, [float(i)] * 64) for i in range(3)]
    assert sorted(map(tuple, ball_kmeans.clustered(vectors(spark, few)).collect()), key=repr) == plain_kmeans(few)
    assert ball_kmeans.clustered(vectors(spark, rows).where("vec_id between 101 and 108")).count() == 0
    with pytest.raises(Exception, match="are exact"):
        ball_kmeans.clustered(vectors(spark, [(1, [1e20] * 64)])).count()


def test_balls_drop_no_nearest_centroid():
    r = np.random.default_rng(7)
    for _ in range(40):
        at, x = r.integers(-9, 10, (12, 3)), r.integers(-12, 13, (80, 3))
        d = ball_kmeans.squared(np.repeat(x, 12, 0) - np.tile(at, (80, 1)), np.zeros(3, np.int64)).reshape(80, 12)
        old = r.integers(0, 12, 80)
        reach = [int(math.isqrt(int(d[old == i, i].max()))) + 1 if (old == i).any() else 2 for i in range(12)]
        new, best, _ = ball_kmeans.Balls(at, reach).assigned(x, old)
        assert (new == d.argmin(1)).all() and (best == d.min(1)).all()


# what was mended in earlier operators


def test_units_of_many_texts_are_cut_between_texts(spark, monkeypatch):
    """Many texts a unit, as in a large table: 1,000 texts of three copies and one of 900, which alone is over a shard."""
    from gapengine.llm import sharding

    monkeypatch.setattr(sharding, "CELLS", 8)
    monkeypatch.setattr(sharding, "SUBCELLS", 2)
    texts = [f"text number {k} " + "y" * (k % 40) for k in range(1000)] * 3 + ["a hot text"] * 900
    got = sharding.sharded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    where, sizes, slots = defaultdict(set), Counter(), defaultdict(list)
    for r in got:
        where[texts[r.doc_id]].add(r.shard)
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert len(got) == len(texts) and {t for t, s in where.items() if len(s) > 1} == {"a hot text"}
    assert max(sizes.values()) <= 1.1 * sum(sizes.values()) / 8 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_notices_in_any_case_and_by_a_shuffle(spark):
    from gapengine.llm import licenses

    texts = ["SPDX-LiCense-Identifier: MIT\ncode", "x\n  released UNDER the mozilla public LICENCE 2.0\nSPDX-License-Identifier: GPL-3.0-or-later", licenses.KNOWN[0][1], "no such thing", None, "word " * 200_000 + "\nLicensed under CC BY 4.0."]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [(0, None, ["MIT"]), (1, None, ["GPL-3.0", "MPL-2.0"]), (2, "MIT", []), (3, None, []), (4, None, []), (5, None, ["CC-BY-4.0"])]
    for small in (100_000, 10):
        assert sorted((r.doc_id, r.license_id, r.notices) for r in licenses.scanned(rows, small=small).collect()) == want


def test_whole_licences_of_a_folder(spark, tmp_path):
    from gapengine.llm import licenses

    (tmp_path / "Own-1.0.txt").write_text("Own License\nYou may read this, and only this.\nCopyright 2020 Somebody")
    rows = spark.createDataFrame([(1, "OWN LICENCE - you may read this and only this")], "doc_id long, text string")
    assert licenses.scanned(rows, [*licenses.KNOWN, *licenses.texts_in(str(tmp_path))]).first().license_id == "Own-1.0"


def test_short_items_are_found_within_texts_but_drop_only_themselves(spark):
    from gapengine.llm import decontaminate

    docs = spark.createDataFrame([(1, "so The quick Fox ran, the quick fox"), (2, "the quick fox"), (3, "quick the fox"), (4, None), (5, ""), (6, "a b c d e f g h i j")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "The quick fox"), (8, "a b c d e f g h i j"), (9, None), (10, "")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.start) for r in decontaminate.leaks(docs, items).collect()) == [(1, 7, 1), (2, 7, 0), (6, 8, 0)]
    assert sorted(r.doc_id for r in decontaminate.without_leaks(docs, items).collect()) == [1, 3, 4, 5]
    for d, i in ((docs, items.limit(0)), (docs.limit(0), items), (docs.limit(0), items.limit(0))):
        assert decontaminate.leaks(d, i).count() == 0 and decontaminate.without_leaks(d, i).count() == d.count()


def test_every_window_of_a_text_is_compared(spark):
    """Brute force: the weighted similarity of each window of an item's size, for texts with planted and edited items."""
    from gapengine.llm import decontaminate

    r = random.Random(11)
    words = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(r.choice(words) for _ in range(r.choice([6, 9, 14, 25])))) for k in range(12)]
    docs = []
    for i in range(60):
        own = [r.choice(words) for _ in range(r.choice([3, 20, 80]))]
        if i % 2:
            t = items[r.randrange(12)][1].split()
            if i % 4 == 3 and len(t) > 12:
                t[r.randrange(len(t))] = "edited"
            own[5:5] = t
        docs.append((i, " ".join(own)))
    shingles = lambda t: Counter(tuple(t[k : k + 5]) for k in range(len(t) - 4))
    bags = {k: shingles(t.split()) for k, t in items}
    n = Counter(s for b in bags.values() for s in b)
    weight = lambda s: math.log1p(len(items) / max(1, n[s]))
    want = {}
    for i, text in docs:
        t = text.split()
        for k, other in bags.items():
            size = min(len(items[k][1].split()), len(t))
            for a in range(len(t) - size + 1):
                bag = shingles(t[a : a + size])
                both = sum(weight(s) * min(x, other[s]) for s, x in bag.items())
                total = sum(weight(s) * x for s, x in bag.items()) + sum(weight(s) * x for s, x in other.items()) - both
                if total and both / total >= 0.8 and both / total > want.get((i, k), (0, 0))[1] + 1e-12:
                    want[i, k] = (a, both / total)
    got = {(x.doc_id, x.item_id): (x.start, x.similarity) for x in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) > 20 and len(want.keys() - got.keys()) <= 0.1 * len(want) and not got.keys() - want.keys()
    assert all(abs(got[k][1] - want[k][1]) < 1e-9 and got[k][0] == want[k][0] for k in got)


def test_toxicity_of_a_very_long_text_and_of_all_its_terms(spark):
    from gapengine.llm import toxicity

    bad = [f"vile{chr(97 + k % 26)}{chr(97 + k // 26)}word" for k in range(60)]
    texts = [f"plain words here {bad[k % 60]} and {bad[(k * 7 + 1) % 60]} again {k}" for k in range(300)] + [f"plain words here then and {k % 11} again {k}" for k in range(900)]
    model = toxicity.fit(texts, [1] * 300 + [0] * 900)
    assert len(set(bad) & set(model.terms)) == 60  # no term is left out for being covered by others
    long = "plain words here " * 200_000
    scored = toxicity.Scorer(model)([long, f"{bad[3]} {bad[9]} again", None, ""])[0]
    assert scored[1] > 0.3 > scored[0] and scored[2] == scored[3]
