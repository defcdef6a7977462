"""The ten operators against brute force, round trips or held-out accuracy; nulls, empty and repeated rows, empty tables and extra columns."""

from __future__ import annotations

import math
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from gapengine.llm import crf_quality, decontaminate, jaccard_join, langid, licenses, mixing, pitman_yor, queries, sharding, toxicity, url_filter

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, sid long, bucket int, size long"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sample_texts():
    r = random.Random(7)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = [None, "", "  \n\t", "one two", "One  TWO", "a b c d e", "Ünï cödé wörds äre hére tóo"]
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.randint(30, 120))]
        texts.append(" ".join(base))
        for _ in range(6):
            other = list(base)
            for _ in range(r.randint(0, 4)):
                other[r.randrange(len(other))] = r.choice(vocabulary)
            texts.append(" ".join(other))
    return texts + texts[7:30] + [" ".join(r.choice(vocabulary) for _ in range(30_000))]


def frame(spark, texts, ids=None):
    ids = list(range(100, 100 + len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, f"s{k % 3}" if k % 5 else None, "en", len(t or ""), 1, 2, 3) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], SCHEMA)


def shingle_set(text):
    w = WORD.findall(lower(text))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def components_of(ids, sets):
    root = dict(zip(ids, ids, strict=True))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if either and 100 * both >= 80 * either:
                x, y = sorted((find(ids[a]), find(ids[b])))
                root[y] = x
    return {i: find(i) for i in ids}


def test_jaccard_components_equal_brute_force(spark):
    texts = sample_texts()
    docs = frame(spark, texts)
    ids, sets = list(range(100, 100 + len(texts))), [shingle_set(t) for t in texts]
    want = components_of(ids, sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == {i: (len(s), want[i]) for i, s in zip(ids, sets, strict=True)}
    kept = sorted(r.doc_id for r in jaccard_join.one_of_each(docs).collect())
    assert kept == sorted(set(want.values()))


def test_jaccard_many_near_copies_with_several_roots(spark):
    r = random.Random(3)
    base = [f"x{k}" for k in range(60)]
    texts = []
    for _ in range(150):
        other = list(base)
        for _ in range(r.randint(0, 3)):
            other[r.randrange(60)] = f"y{r.randrange(500)}"
        texts.append(" ".join(other))
    ids = list(range(100, 250))
    got = {x.doc_id: x.component_id for x in jaccard_join.jaccard_components(frame(spark, texts)).collect()}
    assert got == components_of(ids, [shingle_set(t) for t in texts])


def test_parity_bitmap_bounds_the_overlap():
    import numpy as np

    r = np.random.default_rng(1)
    for n in (5, 80, 3000):
        both, a, b = (r.integers(0, 1 << 47, n).astype(np.uint64) for _ in range(3))
        x, y = np.unique(np.concatenate([both, a])), np.unique(np.concatenate([both, b]))
        differ = sum(int(i ^ j).bit_count() for i, j in zip(jaccard_join._parity(x).view(np.uint64).tolist(), jaccard_join._parity(y).view(np.uint64).tolist(), strict=True))
        assert len(np.setxor1d(x, y)) >= differ


def test_toxicity_separates_held_out_rows(spark):
    scored = {r.doc_id: r for r in queries.op1_toxicity(spark, SF).collect()}
    labels = {r.doc_id: r.toxic for r in queries.table(spark, SF, "labels").collect() if r.toxic is not None}
    held = [(r.predicted, labels[i]) for i, r in scored.items() if r.held_out and i in labels]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in scored.items())
    right = sum(p == y for p, y in held) / len(held)
    share = max(sum(y == 0 for _, y in held), sum(y == 1 for _, y in held)) / len(held)
    assert right >= share


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_matcher_equals_edit_distance():
    terms, r = ["idiot", "stupid", "worthless", "bad", "moro*"], random.Random(5)
    match = toxicity.Matcher(terms)
    for _ in range(600):
        word = list(r.choice(terms).rstrip("*"))
        for _ in range(r.randint(0, 3)):
            word[r.randrange(len(word))] = r.choice(["", "x", "io", "s"])
            word = list("".join(word)) or ["q"]
        word = "".join(word)
        want = {(k, e) for k, t in enumerate(terms) if not t.endswith("*") and (e := levenshtein(word, t)) <= toxicity.budget(t)} | {(k, 0) for k, t in enumerate(terms) if t.endswith("*") and word.startswith(t[:-1])}
        assert set(match(word)) == want


def test_decontaminate_finds_planted_items(spark):
    items = [(1, " ".join(f"q{k}" for k in range(40))), (2, "who wrote the very long book"), (3, None), (4, "two words")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    noise = " ".join(f"n{k}" for k in range(300))
    edited = items[0][1].replace("q39", "other")
    texts = [f"{noise} {items[0][1]} {noise}", noise, None, "", f"{noise} {edited}", "Who wrote the very long book?", "two words", noise]
    docs = frame(spark, texts)
    assert {(r.doc_id - 100, r.item_id) for r in decontaminate.leaks(docs, benchmark).collect()} == {(0, 1), (4, 1), (5, 2), (6, 4)}
    assert sorted(r.doc_id - 100 for r in decontaminate.without_leaks(docs, benchmark).collect()) == [1, 2, 3, 7]
    assert decontaminate.leaks(docs, benchmark.limit(0)).isEmpty()


def test_decontaminate_finds_items_that_a_shorter_document_cuts(spark):
    items = {1: [f"q{k}" for k in range(15)], 2: [f"r{k}" for k in range(59)], 3: [f"s{k}" for k in range(40)]}
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    texts = [" ".join(w) for w in (items[1][:14], items[1][1:], items[2][1:], items[2][1:58], items[3][:20], items[1][:5], items[1][:4])]
    docs = frame(spark, texts)
    got = {(r.doc_id - 100, r.item_id): (r.start, r.similarity) for r in decontaminate.leaks(docs, benchmark).collect()}
    assert got == {(0, 1): (0, pytest.approx(10 / 11)), (1, 1): (0, pytest.approx(10 / 11)), (2, 2): (0, pytest.approx(54 / 55)), (3, 2): (0, pytest.approx(53 / 55))}
    assert sorted(r.doc_id - 100 for r in decontaminate.without_leaks(docs, benchmark).collect()) == [4, 5, 6]


def test_decontaminate_finds_the_same_in_any_blocks(spark, monkeypatch):
    common = " ".join(f"c{k}" for k in range(30))
    items = [(i, f"{common} " + " ".join(f"i{i}x{k}" for k in range(20))) for i in range(1, 25)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    texts = [t.replace(w, "other") for _, t in items[::3] for w in ("c9 ", "c15", "c20")] + [t.replace("c9", "o1").replace("c15", "o2").replace("c22", "o3") for _, t in items[::5]] + [common, items[23][1], items[7][1].replace("x9", "y")]
    docs = frame(spark, texts)
    found, kept = [], []
    for size in (4096, 23, 5, 1):
        monkeypatch.setattr(decontaminate, "ITEMS", size)
        found.append(sorted((r.doc_id, r.item_id, r.start, round(r.similarity, 9)) for r in decontaminate.leaks(docs, benchmark).collect()))
        kept.append(sorted(r.doc_id for r in decontaminate.without_leaks(docs, benchmark).collect()))
    assert found[0] and all(x == found[0] for x in found) and all(x == kept[0] for x in kept)


def poisson(rate, u):
    term = total = math.exp(-rate)
    k = 0
    while u >= total:
        k += 1
        term *= rate / k
        total += term
    return k


def test_mixing_equals_poisson_inversion(spark):
    import hashlib

    docs = frame(spark, sample_texts())
    rows = docs.collect()
    n = Counter(r.source for r in rows)
    weight = sum(math.sqrt(x) for x in n.values())
    want = Counter()
    for r in rows:
        u = int(hashlib.md5(f"mix-1\x1f{r.doc_id}\x1f{r.source or ''}".encode()).hexdigest()[:13], 16) / (1 << 52)
        want[r.doc_id] += poisson(len(rows) * math.sqrt(n[r.source]) / weight / n[r.source], u)
    got = Counter(r.doc_id for r in mixing.mixed(docs).collect())
    assert got == +want
    assert mixing.mixed(docs.limit(0)).isEmpty()


def test_mixing_splits_large_means(spark):
    import hashlib

    weights = {"a": 1.0, "b": 1.0, "c": 8.0}
    docs = spark.createDataFrame([(i, "a") for i in range(9000)] + [(9000, "b"), (None, "c"), (9001, "c")], "doc_id long, source string")
    n, want = {"a": 9000, "b": 1, "c": 2}, {}
    for r in docs.collect():
        rate = 9003 * weights[r.source] / 10 / n[r.source]
        draws = max(1, math.ceil(rate / mixing.MOST))
        keys = ["\x1f".join(["mix-1", str(r.doc_id) if r.doc_id is not None else "", r.source, *([str(j)] if j > 1 else [])]) for j in range(1, draws + 1)]
        want[r.doc_id] = sum(poisson(rate / draws, int(hashlib.md5(k.encode()).hexdigest()[:13], 16) / (1 << 52)) for k in keys)
    got = defaultdict(list)
    for r in mixing.mixed(docs, weights).collect():
        assert r.n_copies == want[r.doc_id]
        got[r.doc_id].append(r.copy_no)
    assert {i: sorted(k) for i, k in got.items()} == {i: list(range(1, k + 1)) for i, k in want.items() if k}
    assert all(abs(want[i] - 9003 * w / 10 / m) < 6 * math.sqrt(9003 * w / 10 / m) for i, w, m in ((9000, 1, 1), (None, 8, 2), (9001, 8, 2)))


def test_sharding_laws(spark):
    texts = sample_texts()
    got = sharding.sharded(frame(spark, texts)).collect()
    assert sorted(r.doc_id for r in got) == list(range(100, 100 + len(texts)))
    slots = defaultdict(list)
    for r in got:
        data = (texts[r.doc_id - 100] or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "bytes") and 0 <= r.shard < 8
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_balances_bytes(spark):
    sizes = defaultdict(int)
    for r in queries.op8_vector_shards(spark, SF).collect():
        sizes[r.shard] += r["size"]
    assert len(sizes) == 8 and max(sizes.values()) <= 1.05 * sum(sizes.values()) / 8


def test_quality_base_counts_equal_brute_force(spark):
    texts = [*sample_texts()[:40], "a b c d e f a b c d e f", "same line here\nsame line here\n\n\nother # * |", "é ü x\ny"]
    got = {r.doc_id: r for r in crf_quality.verdicts(frame(spark, texts), crf_quality.Chain()).collect()}
    for i, t in enumerate(texts, 100):
        t = t or ""
        w, r = WORD.findall(t), got[i]
        seen, again, lines = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)), set(), Counter()
        for k in range(len(w) - 4):
            if seen[tuple(w[k : k + 5])] > 1:
                again |= set(range(k, k + 5))
        lines.update(x for x in t.split("\n") if WORD.search(x))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), sum(lines.values()) - len(lines), len(again)), t[:50]
        assert r.base_failed == (len(w) < 10 or 100 * len(again) > 20 * len(w)) and not (r.base_failed and r.kept)


def test_language_model_base_and_probabilities(spark):
    texts = sample_texts()
    tokens = {i: [*WORD.findall(lower(t)), None] for i, t in enumerate(texts, 100)}
    counts = Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in t)
    n, v = sum(counts.values()), len(counts)
    for r in pitman_yor.scored(frame(spark, texts)).collect():
        t = tokens[r.doc_id]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(w in counts for w in t), n, zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert r.base_score == pytest.approx(base) and r.score < 0


@pytest.mark.parametrize("n, d, p", [(1000, 0.9, 0.5), (20_000, 0.9, 0.5), (20_000, 0.75, 0.2), (60, 0.6, 0.3)])
def test_large_counts_open_as_many_tables_as_one_by_one(n, d, p):
    import numpy as np

    chains, r = 400, np.random.default_rng(11)
    one_by_one = np.ones(chains)
    for i in range(1, n):
        a = (pitman_yor.CONCENTRATION + d * one_by_one) * p
        one_by_one += r.random(chains) < a / (a + i - d * one_by_one)
    own = np.ones(chains, np.int64)
    got = pitman_yor.seated(own * n, own * p, d, r.integers(0, 1 << 63, chains).astype(np.uint64))
    error = math.hypot(one_by_one.std(), got.std()) / math.sqrt(chains)
    assert abs(got.mean() - one_by_one.mean()) < 4 * error + 0.01 * one_by_one.mean(), (got.mean(), one_by_one.mean())


def test_url_filter_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = sorted(map(str, con.execute(queries.URL_SQL).fetchall()))
    assert sorted(str(tuple(r)) for r in queries.op10_url_filter(spark, SF).select("page_id", "host", "path", "rule", "verdict").collect()) == want


def test_url_filter_carries_blocks_to_aliases(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", '<link rel="canonical" href="http://www.b.com/de/1">'), (2, None, None), (3, "no scheme", ""), (4, "http://c.net/", None)], "page_id long, url string, html string")
    moved = spark.createDataFrame([("http://c.net/", "http://a.net/x"), (None, "http://q.net/")], "source string, target string")
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in url_filter.judged(pages, redirects=moved).collect()}
    assert got == {1: ("a.net", None, "block"), 2: ("", None, "allow"), 3: ("", None, "allow"), 4: ("c.net", None, "block")}


def test_url_filter_reads_every_form_of_alias(spark):
    link, meta = '<link rel="canonical" href="%s">', '<meta http-equiv="refresh" content="%s">'
    forms = {
        "<link rel=canonical href=http://b.com/de/1>": "block", "<link href=http://b.com/de/1 rel=canonical>": "block", "<LINK HREF = 'http://b.com/de/1' REL = 'canonical'/>": "block",
        "<link rel='nofollow canonical' href='http://b.com/de/1'>": "block", meta % "0; url='http://b.com/de/1'": "block", "<meta http-equiv=refresh content=0;url=http://b.com/de/1>": "block",
        "<meta content='0;URL=http://b.com/de/1' http-equiv='Refresh'>": "block", "<meta content=\"5; url='http://b.com/de/1'\" http-equiv=refresh>": "block", link % "//b.com/de/1": "block", link % "//B.com/de/1#top": "block",
        "<link rel=stylesheet href=http://b.com/de/1>": "allow", "<link rel=canonical data-href=http://b.com/de/1>": "allow", "<meta name=x content='0;url=http://b.com/de/1'>": "allow", link % "/b.com/de/1": "allow", link % "mailto:x": "allow",
    }
    pages = [(k, f"http://a{k}.net/x", html) for k, html in enumerate(forms)]
    moved = {100: ("http://c.net/d/e/x?q", link % "y", "c.net/d/e/y"), 101: ("http://c.net/d/e/x", link % "../y?z", "c.net/d/y?z"), 102: ("http://c.net", meta % "0;url=./y", "c.net/y"), 103: ("http://c.net/d/x", link % "/r/../s", "c.net/s"), 104: ("http://c.net/d/x?q", link % "?p", "c.net/d/x?p"), 105: ("http://c.net/d/x", link % "/r?u=http://b.com/de/1", "c.net/r?u=http://b.com/de/1")}
    table = lambda rows: spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in url_filter.judged(table(pages)).collect()} == dict(enumerate(forms.values()))
    for url, html, want in moved.values():
        assert [r.b for r in url_filter.links(table([(1, url, html)])).collect()] == [want]


def test_licences(spark):
    mit = licenses.KNOWN[0][1]
    texts = [mit, f"Copyright (c) 2020 Someone\n\n{mit.upper()}", f"{mit} and more", "Some text\nReleased under the MIT Licence\nmore", None, "", "..."]
    got = {r.doc_id - 100: (r.license_id, r.notices) for r in licenses.scanned(frame(spark, texts)).collect()}
    assert got == {0: ("MIT", []), 1: ("MIT", []), 2: (None, []), 3: (None, ["MIT"]), 4: (None, []), 5: (None, []), 6: (None, [])}


@pytest.mark.parametrize("name, text", licenses.KNOWN)
def test_licences_with_other_line_breaks_and_notices(name, text):
    known, one = licenses.known_digests(), " ".join(text.split())
    texts = [one, *(textwrap.fill(one, width) for width in range(20, 110, 3))]
    for notice in ("Copyright (c) 2020 X.", "Copyright (c) 2020 Some Holder.", "Copyright 2019-2020 J. R. Smith, Foo Inc. All rights reserved.", "© 2020 Foo Inc. and contributors", "Copyright Foo"):
        texts += [f"{notice}\n{text}", f"# {notice}\n\n{one.upper()}", f"{notice}\n{textwrap.fill(one, 50)}", *([f"{notice} {one}"] if "20" in notice else [])]
    assert [known.get(licenses.digest(t.encode())) for t in texts] == [name] * len(texts)
    assert licenses.digest(f"{text}\nand more of copyright".encode()) not in known


def test_language_of_documents(spark):
    got = {r.doc_id: r.language for r in queries.op3_language_id(spark, SF).where("origin = 'documents'").collect()}
    want = {r.doc_id: r.lang for r in queries.table(spark, SF, "documents").where("lang is not null and length(text) > 50").collect()}
    assert sum(got[i] == x for i, x in want.items()) >= 0.9 * len(want)


@pytest.mark.parametrize("apply", [jaccard_join.jaccard_components, mixing.mixed, sharding.sharded, pitman_yor.scored, licenses.scanned, lambda d: crf_quality.verdicts(d, crf_quality.Chain()), lambda d: toxicity.scores(d, toxicity.fit([], [])), lambda d: langid.identified(langid.evidence(d, None), langid.train(d))])
def test_empty_tables_and_null_ids(spark, apply):
    assert apply(frame(spark, [])).isEmpty()
    apply(frame(spark, [None, "", "a b c d e f", "a b c d e f", None], [None, 1, 1, 1, 2])).collect()
