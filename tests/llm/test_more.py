"""Results that don't move with blocks, sizes or layouts; laws of packing, labelling and language models; clashing names; SQL."""

from __future__ import annotations

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from gapengine.llm import crf_quality, decontaminate, jaccard_join, langid, mixing, pitman_yor, queries, sharding, toxicity, url_filter

SF = "/root/testdata/sf0.01"


def texts_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_mixing_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(map(str, con.execute(queries.MIX_SQL).fetchall()))
    assert sorted(str(tuple(r)) for r in queries.op5_mix_sources(spark, SF).collect()) == want


def test_mixing_with_clashing_names(spark):
    rows = [(i, f"s{i % 3}", 1, 2, 3, 4, 5) for i in range(40)]
    plain = spark.createDataFrame([r[:2] for r in rows], "doc_id long, source string")
    wide = spark.createDataFrame(rows, "doc_id long, source string, cdf int, mix_source int, mix_u int, draws int, mix__part int")
    got = mixing.mixed(wide)
    assert set(wide.columns) <= set(got.columns) and Counter(r.doc_id for r in got.collect()) == Counter(r.doc_id for r in mixing.mixed(plain).collect())
    with pytest.raises(ValueError):
        mixing.mixed(plain.withColumnRenamed("doc_id", "copy_no"))


def test_equal_texts_share_a_shard_unless_they_fit_into_none(spark):
    r = random.Random(1)
    texts = [f"text {k} " + "x" * r.randint(0, 60) for k in range(600)]
    copies = [texts[3]] * 40 + [texts[5]] * 25 + ["é" * 30] * 30
    got = sharding.sharded(texts_of(spark, list(enumerate(texts + copies)))).collect()
    where = defaultdict(set)
    for x in got:
        where[x.text_crc32].add(x.shard)
    assert all(len(s) == 1 for s in where.values())
    hot = sharding.sharded(texts_of(spark, list(enumerate(texts + ["hot text of many rows"] * 900)))).collect()
    where, sizes, slots = defaultdict(set), Counter(), defaultdict(list)
    for x in hot:
        where[x.text_crc32].add(x.shard)
        sizes[x.shard] += x["size"]
        slots[x.shard].append(x.slot)
    assert [len(s) > 1 for k, s in where.items() if k == zlib.crc32(b"hot text of many rows")] == [True] and sum(len(s) > 1 for s in where.values()) == 1
    assert max(sizes.values()) <= 1.1 * sum(sizes.values()) / 8 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_packing_follows_the_dot_product():
    r = np.random.default_rng(2)
    sizes = r.integers(1, 50, (60, 3)).astype(float)
    where, cut = sharding.packed(sizes, 4)
    v, rest = sizes / sizes.sum(0) * 4, np.ones((4, 3))
    for k in sorted(range(60), key=lambda k: (-v[k].max(), k)):
        fits = [s for s in range(4) if all(rest[s][d] >= v[k][d] - 1e-12 for d in range(3))]
        want = max(fits, key=lambda s: (sum(rest[s][d] * v[k][d] for d in range(3)), -s)) if fits else max(range(4), key=lambda s: (rest[s][0], -s))
        assert where[k] == want
        rest[want] -= v[k]
    assert not cut and abs(rest).max() < 0.35


def chain_score(chain, x, labels):
    return sum(float(x[i] @ chain.emit[:, y]) for i, y in enumerate(labels)) + sum(chain.trans[a, b] for a, b in itertools.pairwise(labels))


def test_viterbi_and_gradient_equal_enumeration():
    r = np.random.default_rng(6)
    for _ in range(40):
        chain = crf_quality.Chain(r.normal(size=(crf_quality.N_FEATURES, 2)), r.normal(size=(2, 2)))
        lengths = r.integers(1, 7, 3)
        x = r.normal(size=(int(lengths.sum()), crf_quality.N_FEATURES))
        start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        got = chain.viterbi(x, start, lengths)
        for s, n in zip(start, lengths, strict=True):
            best = max(itertools.product((0, 1), repeat=int(n)), key=lambda y: chain_score(chain, x[s : s + n], y))
            assert tuple(got[s : s + n]) == best
    n = 4
    x, y = r.normal(size=(1, n, crf_quality.N_FEATURES)), r.integers(0, 2, (1, n))
    mask = np.ones((1, n), bool)

    def likelihood(chain):
        all_scores = [chain_score(chain, x[0], z) for z in itertools.product((0, 1), repeat=n)]
        return chain_score(chain, x[0], y[0]) - math.log(sum(math.exp(v) for v in all_scores))

    like, emit, trans = chain.gradient(x, y, mask)
    assert like == pytest.approx(likelihood(chain))
    for grad, weights in ((emit, chain.emit), (trans, chain.trans)):
        for at in ((0, 0), (1, 1), (0, 1)):
            weights[at] += 1e-6
            up = likelihood(chain)
            weights[at] -= 2e-6
            down = likelihood(chain)
            weights[at] += 1e-6
            assert grad[at] == pytest.approx((up - down) / 2e-6, abs=1e-4)


def test_line_labels_learn_from_long_documents(monkeypatch):
    good, bad = "this line has some seven plain words.\n", "| *** | %% |\n"
    texts = [(good * 700).encode(), (bad * 700).encode()] * 3
    chain = crf_quality.fitted(texts, [1, 0] * 3)
    out = crf_quality.judge([(good * 4).encode(), (bad * 30).encode()], chain)
    assert out["content_share"][0] > 0.9 > 0.1 > out["content_share"][1]
    one = crf_quality.fitted([good.encode()], [1])
    assert crf_quality.fitted([], []).emit[0, 1] == one.emit[0, 1] == 1.0


@pytest.mark.parametrize("seed", [1, 2])
def test_simhash_finds_what_is_similar(seed):
    r = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(3000)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(15, 60))).encode()) for i in range(300)]
    index = decontaminate.Index(items)
    similar = found = 0
    for k, (i, text) in enumerate(items):
        words = text.decode().split()
        for _ in range(r.randint(0, 2)):
            words[r.randrange(len(words))] = "other"
        bags = [Counter(decontaminate.item_shingles(decontaminate.words(t)).tolist()) for t in (text, " ".join(words).encode())]
        weight = dict(zip(bags[1], index.weigh(np.array(list(bags[1]), np.uint64)).tolist(), strict=True))
        if index.similar(bags[1], k, weight) >= 0.8:
            similar += 1
            noise = " ".join(r.choice(vocabulary) for _ in range(80))
            found += any(x[1] == k for x in decontaminate.batch_leaks([f"{noise} {' '.join(words)} {noise}".encode()], index))
    assert similar > 100 and found >= 0.9 * similar


def test_toxicity_by_recall_and_precision(spark):
    sf = "/root/testdata/sf0.1"
    scored = {r.doc_id: r for r in queries.op1_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in queries.table(spark, sf, "labels").collect() if r.toxic is not None}
    held = [(r.score, labels[i]) for i, r in scored.items() if r.held_out and i in labels]
    ones, zeros = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    area = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))
    assert area >= 0.95 and sum(s >= 0.3 for s in ones) >= 0.9 * len(ones) and sum(s >= 0.3 for s in zeros) <= 0.02 * len(zeros)


def test_toxicity_of_a_sample_keeps_the_share_of_all():
    r = random.Random(3)
    words = [f"w{k}" for k in range(50)]
    make = lambda y: " ".join(r.choice(words) for _ in range(20)) + (" vilename" if y and r.random() < 0.7 else "")
    whole = [(make(y), y) for y in [1] * 100 + [0] * 900]
    part = [x for x in whole if x[1]] + [x for x in whole if not x[1]][:100]
    a, b = toxicity.fit(*zip(*whole, strict=True)), toxicity.fit(*zip(*part, strict=True), share=0.1)
    plain = make(0)
    assert abs(toxicity.Scorer(a)([plain])[0][0] - toxicity.Scorer(b)([plain])[0][0]) < 0.05
    said, misspelt, nothing = (float(toxicity.Scorer(b)([f"{plain}{x}"])[0][0]) for x in (" vilename", " vi1ename", ""))
    assert said > 0.3 > nothing and misspelt > nothing


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0), (2, 0)], [(None, 1), (1, None)]])
def test_training_without_both_classes(spark, labels):
    docs = texts_of(spark, [(1, "some words here"), (2, None), (None, ""), (1, "some words here")])
    for module, column in ((toxicity, "toxic"), (crf_quality, "quality")):
        model = module.train(docs, spark.createDataFrame(labels, f"doc_id long, {column} int"))
        out = (toxicity.scores if module is toxicity else crf_quality.verdicts)(docs, model)
        assert out.count() == 4


def test_language_without_a_cap(spark):
    r = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(70):
        own = [("".join(r.choice(letters) for _ in range(4))) for _ in range(6)]
        rows += [(k * 10 + i, " ".join(r.choice(own) for _ in range(40)), f"l{k:02d}", "host") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {x.row_id: x.language for x in langid.identified(langid.evidence(docs, None), langid.train(docs)).collect()}
    assert sum(got[i] == lang for i, _, lang, _ in rows) >= 0.95 * len(rows)


def test_hosts_priors_are_shrunk_to_their_parents(spark, monkeypatch):
    rows = [("pages", k, None, "a.x.de" if k < 30 else "b.x.de" if k < 33 else "c.y.de", "de" if k % 3 else "en") for k in range(36)]
    table = spark.createDataFrame(rows, "origin string, row_id long, text string, host string, declared string")
    profile = langid.Profile(["de", "en"], np.zeros((2, langid.TABLE)))
    whole = sorted(map(tuple, langid.identified(table, profile).collect()))
    monkeypatch.setattr(langid, "HOT", 5)
    assert [(*x[:-1], round(x[-1], 9)) for x in sorted(map(tuple, langid.identified(table, profile).collect()))] == [(*x[:-1], round(x[-1], 9)) for x in whole]


# ---- language model: the same functions that Spark runs, in one process


def batch(docs):
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs], pa.int64()), pa.array([t for _, t in docs], pa.string())], ["doc_id", "text"])


def dealt(batches):
    out = defaultdict(list)
    for b in batches:
        for row in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            out[row[0]].append(row)
    return out


def model(docs, n, limit):
    """Probabilities by (a, b, w), and the rows that come out."""
    m, first = pitman_yor, [batch(docs)]
    counts = Counter()
    for f in m.frequent(0.0)(first):
        for a, b, k in zip(*(f.column(i).to_pylist() for i in range(3)), strict=True):
            counts[a, b] += k
    key = lambda x: np.array(x, np.int64).view(np.uint64)
    words = np.unique(key([b for (a, b), k in counts.items() if a is None and k >= limit]))
    two = [ab for ab, k in counts.items() if ab[0] is not None and k >= limit]
    pairs = m.pair_hash(key([a for a, _ in two]), key([b for _, b in two]))
    order = np.argsort(pairs)
    hot = m.Hot(words, pairs[order], np.searchsorted(words, key([b for _, b in two]))[order])
    again = lambda rows: [m._rows(rows)]
    messages, lower = defaultdict(list), np.zeros(4)
    for rows in dealt(m.routed(n, hot, False)(first)).values():
        for b in m.told(n, hot)(again(rows)):
            for row in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if row[1] == 3:
                    lower += row[3]
                else:
                    messages[row[0]].append(row[:3])
    upper = dealt(b for rows in messages.values() for b in m.merged(hot)(again(rows)))
    history, d, v, train = [], m.DISCOUNTS, 0, 0
    for k in range(m.UPPER + 1):
        C, T, extra = np.zeros(len(hot)), np.zeros(len(hot)), np.zeros((4, 2))
        for rows in upper.values():
            for b in m.swept(hot, history, d, v)(again(rows)):
                for r, x, y in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    if r < 0:
                        extra[-r - 1] += (x, y)
                    else:
                        C[r] += x
                        T[r] += y
        if not k:
            v, train = map(int, extra[0])
            d = m.discounts(np.concatenate([extra[1], lower[:2] + extra[2], lower[2:] + extra[3]]))
        history.append((C, T))
    answers = dealt(b for rows in messages.values() for b in m.answered(hot, history[:-1], history[-1], d, v)(again(rows)))
    second = dealt(m.routed(n, hot, True)(first))
    probabilities = {}
    for k, rows in second.items():
        if payloads := [p for _, kind, p in rows if kind == 0]:
            b = m.Bucket(payloads, hot, n)
            entries = np.zeros(len(b.entry_r))
            told = {int(m.unpack(p)[0][0]): m.unpack(p)[2] for *_, p in answers[k]}
            for to, i, j in b.cuts():
                entries[i:j] = told[to]
            b.sweep(entries, d, 7)
            for row in zip(b.keys[b.a].tolist(), b.keys[b.b].tolist(), b.keys[b.w].tolist(), b.scores(entries, d).tolist(), strict=True):
                probabilities[row[:3]] = row[3]
    parts = dealt(b for k, rows in second.items() for b in m.scored_buckets(n, hot, d)(again([*rows, *answers.get(k, [])])))
    out = [r for rows in parts.values() for b in m.finished(train, v)(again(rows)) for r in b.to_pylist()]
    return hot, probabilities, out


def numbers(held):
    return (i for i in itertools.count(1) if (zlib.crc32(str(i).encode()) % 5 == 1) == held)


@pytest.mark.parametrize("buckets, limit", [(1, 10**9), (3, 10**9), (3, 40), (5, 12)])
def test_probabilities_of_all_words_sum_to_one(buckets, limit):
    r = random.Random(4)
    words = [f"w{k}" for k in range(12)]
    train = [(i, " ".join(r.choice(words[: k + 1]) for k in range(12)) + " w10 w11") for i in itertools.islice(numbers(False), 60)]
    contexts = [("w0", "w1"), ("w1", "w0"), ("w5", "w9"), ("none", "w1"), ("none", "nor"), ("w0", "nor")]
    ids = numbers(True)
    held = [(next(ids), f"{a} {b} {w}".strip()) for a, b in contexts for w in [*words, "unseen", ""]]
    hot, p, out = model(train + held, buckets, limit)
    assert (len(hot.words) > 0) == (limit < 10**9)
    code = lambda w: int(pitman_yor.word_hashes([w.encode()])[0][0])
    for a, b in contexts:
        assert sum(p[code(a), code(b), w] for w in [*map(code, [*words, "unseen"]), int(pitman_yor.END)]) == pytest.approx(1, abs=1e-5)
    assert len(out) == len(train + held) and all(x["perplexity"] == pytest.approx(10 ** (-x["score"] / x["n_tokens"])) for x in out)


def test_a_text_that_was_learned_scores_better(spark):
    r = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    ids, held = numbers(False), numbers(True)
    train = [(next(ids), " ".join(r.choice(words) for _ in range(60))) for _ in range(80)]
    fresh = [(next(held), " ".join(r.choice(words) for _ in range(60))) for _ in range(10)]
    copies = [(next(held), t) for _, t in train[:10]]
    got = {x.doc_id: x for x in pitman_yor.scored(texts_of(spark, train + fresh + copies)).collect()}
    mean = lambda rows: sum(got[i].score - got[i].base_score for i, _ in rows) / len(rows)
    assert mean(copies) > mean(fresh) + 20


def test_customers_are_removed_and_seated_like_explicit_tables():
    rng, d, p, other, n = np.random.default_rng(3), 0.7, 0.1, 3, 6
    total = []
    for _ in range(400):
        sizes = [n]
        for _ in range(60):
            k = rng.choice(len(sizes), p=np.array(sizes) / sum(sizes))
            sizes[k] -= 1
            sizes = [s for s in sizes if s]
            a = (pitman_yor.CONCENTRATION + d * (other + len(sizes))) * p
            if not sizes or rng.random() < a / (a + n - 1 - d * len(sizes)):
                sizes.append(1)
            else:
                w = np.array(sizes) - d
                sizes[rng.choice(len(sizes), p=w / w.sum())] += 1
        total.append(len(sizes))
    many = 4000
    t = np.ones(many, np.int64)
    for k in range(10):
        tables = (other + t).astype(float)
        t = pitman_yor.moved(np.full(many, n), t, np.arange(many), tables, np.full(many, p), d, pitman_yor.c.mixed(np.arange(many, dtype=np.uint64) + np.uint64(k * 104729)))
        assert (tables == other + t).all()
    assert abs(t.mean() - np.mean(total)) < 4 * np.std(total) / math.sqrt(len(total))
    exact, limit = pitman_yor.alone(np.array([256]), np.array([60]), d), np.interp(60 / 256, *pitman_yor._alone(d)[1:])
    assert exact[0] == pytest.approx(limit, rel=0.02)


def test_aliases_in_sql_and_operator(spark):
    pages = [(1, "http://a.net/x", '<link rel="canonical" href="//www.b.com/de/1">'), (2, "http://www.b.com/de/1", ""), (3, "http://c.net/", '<link rel="canonical" href="http://d.com/fr/2">'), (4, "http://c.net/q", '<link rel="canonical" href="/">'), (5, None, None), (6, "http://a.net/x", None)]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = sorted(str(tuple(r)) for r in url_filter.judged(table).select("page_id", "host", "path", "rule", "verdict").collect())
    assert got == sorted(map(str, con.execute(queries.URL_SQL).fetchall()))
    assert "block" in got[0] and url_filter.judged(table.limit(0)).isEmpty()


def test_pipeline_keeps_columns_and_its_order(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "decontaminate", "mix_sources", "vector_shards"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, kept, str(tmp_path))
        assert out.columns == docs.columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        before, kept = kept, spark.read.parquet(path)
        assert kept.join(before, kept.columns, "left_anti").isEmpty() and 0 < kept.count() <= before.count()
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    copies = Counter(r.doc_id for r in mixing.mixed(kept).collect())
    assert Counter(r.doc_id for r in rows) == copies and {r.shard for r in rows} == set(range(8))
    components = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(kept).collect()}
    assert len(set(components.values())) == len(components)


def test_quality_verdict_on_held_out_rows():
    rows = duckdb.sql("SELECT d.doc_id, text, quality FROM '/root/testdata/sf0.1/documents.parquet' d JOIN '/root/testdata/sf0.1/labels.parquet' l USING (doc_id) WHERE quality IS NOT NULL AND text IS NOT NULL ORDER BY md5(d.doc_id::VARCHAR)").fetchall()
    held, learned = rows[::4], [r for k, r in enumerate(rows) if k % 4]
    sample = [(t.encode(), q) for want, n in crf_quality.SAMPLE.items() for _, t, q in [r for r in learned if r[2] == want][:n]]
    chain = crf_quality.fitted([t for t, _ in sample], [q for _, q in sample])
    kept = np.concatenate([crf_quality.judge([t.encode() for _, t, _ in held[i : i + 256]], chain)["kept"] for i in range(0, len(held), 256)])
    good = np.array([q == 1 for *_, q in held])
    assert (kept == good).mean() >= 0.95 and kept[~good].mean() <= 0.02
