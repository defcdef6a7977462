"""Small parts that no other test names: packets, identifiers, addresses, canonical JSON, quotes, drafts, proposals."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gapengine.functions import text
from gapengine.operators import framing, labeling, needs, rank, report
from gapengine.sources import artifacts


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_places_are_a_permutation_for_each_key(spark, n):
    df = spark.range(n).withColumn("a", labeling.permuted(F.col("id"), n, F.lit("1:ann"))).withColumn("b", labeling.permuted(F.col("id"), n, F.lit("1:ben")))
    got = df.orderBy("id").collect()
    assert sorted(r.a for r in got) == sorted(r.b for r in got) == list(range(n))
    if n >= 97:  # neither in order nor alike
        assert sum(r.a == r.b for r in got) < n / 5 and sum(r.a == r.id for r in got) < n / 5
        assert 0.3 < sum(x.a < y.a for x, y in zip(got, got[1:], strict=False)) / n < 0.7


def test_packets_are_whole_blind_and_repeatable(spark):
    pairs = spark.createDataFrame([(f"p{k}", f"text {k}", "MATCH") for k in range(50)], "pair_id string, body string, verdict string")
    rows = labeling.packets(pairs, ["pair_id", "body"], ["ann", "ben"], 3)
    got = sorted(map(tuple, rows.collect()))
    assert rows.columns == ["reviewer", "position", "pair_id", "body"] and len(got) == 100
    assert got == sorted(map(tuple, labeling.packets(pairs.orderBy(F.desc("pair_id")), ["pair_id", "body"], ["ben", "ann"], 3).collect()))
    for who in ("ann", "ben"):
        assert [g[1] for g in got if g[0] == who] == list(range(50)) and {g[2] for g in got if g[0] == who} == {f"p{k}" for k in range(50)}
    assert [r.pair_id for r in labeling.packet(pairs, ["pair_id"], "ann", 3).collect()] == [g[2] for g in got if g[0] == "ann"]
    for columns, who in ((["pair_id", "Verdict"], ["a", "b"]), (["pair_id"], ["a"]), (["pair_id"], ["a", "a "])):
        with pytest.raises(ValueError):
            labeling.packets(pairs, columns, who)
    assert labeling.packets(pairs.limit(0), ["pair_id"], ["a", "b"]).isEmpty()


def test_merge_proposals(spark):
    known = spark.createDataFrame([("N1",), ("N2",), ("N3",)], "id string")
    asked = spark.createDataFrame([(1, "N1"), (1, "N2"), (2, "N2"), (2, "N3"), (3, "N9")], "group_id int, need_id string")
    assert sorted(map(tuple, needs.invalid_merges(asked, known).collect())) == [(1, "N2", "reused"), (2, "N2", "reused"), (3, "N9", "unknown")]


def test_first_members_and_unnameable_clusters(spark):
    rows = spark.createDataFrame([(c, f"S{k:02d}") for c, n in ((1, 5), (2, 2)) for k in range(n)], "cluster int, id string")
    assert sorted(map(tuple, needs.capped(rows, "cluster", "id", 3).collect())) == [(1, "S00"), (1, "S01"), (1, "S02"), (2, "S00"), (2, "S01")]
    clusters = spark.createDataFrame([(k,) for k in (1, 2, 3)], "cluster int")
    matches = spark.createDataFrame([(1, "access", 4)], "cluster int, domain string, score long")
    aspects = spark.createDataFrame([(1, "x"), (2, "login"), (3, "weather")], "cluster int, aspect string")
    domains = spark.createDataFrame([("access", "login"), ("access", "weather")], "domain string, word string")
    assert [r.cluster for r in needs.unnameable(clusters, matches, aspects, domains, "cluster").collect()] == []
    assert [r.cluster for r in needs.unnameable(clusters, matches, aspects, domains, "cluster", weak=("weather",)).collect()] == [3]
    assert [needs.adaptive_minimum(3, n) for n in (1, 16, 24, 100)] == [2, 2, 3, 3] and rank.shortfall(5, 3) == 2


def test_addresses_and_canonical_json(spark):
    urls = ["https://github.com/own/repo/issues/1", "http://github.com/own/repo/issues/1", "https://github.com/own/repository", "https://github.com/own/repo/a b", "https://github.com/own/repo/<x>", "https://github.com/own/repo/x@y", None]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(text.safe_url(F.col("u"), "own/repo").alias("ok")).collect()
    assert [r.ok for r in got] == [True, False, False, False, False, False, False]
    assert list(artifacts.canonical({"b": [{"d": 1, "c": 2}], "a": "é"})) == ["a", "b"] and list(artifacts.canonical([{"d": 1, "c": 2}])[0]) == ["c", "d"]
    assert artifacts.contract_hash({"b": [1, 2.5], "a": "é"}) == artifacts.contract_hash({"a": "é", "b": [1, 2.5]}) != artifacts.contract_hash({"a": "é", "b": [2.5, 1]})


def test_quotes_of_items_and_joined_texts(spark):
    rows = spark.createDataFrame([("First part. The Login fails here! Last.", "Title", ["missing", "login"]), ("nothing of it", "Title", ["login"]), ("x", "Title", [])], "body string, title string, terms array<string>")
    assert [r.q for r in rows.select(framing.quote(F.col("body"), F.col("title"), F.col("terms")).alias("q")).collect()] == ["The Login fails here!", "Title", "Title"]
    assert spark.range(1).select(text.joined_text(F.lit(" a "), F.lit("  "), F.lit(None).cast("string"), F.lit("b")).alias("t")).first().t == "a\nb"


def test_ticket_drafts():
    draft = report.ticket({"title": "Login", "verdict": "IGNORED", "score": 0.12345}, ["q" * 300, "second", "third"], budget=2, width=10)
    assert draft == "# Login\n\nVerdict: IGNORED\nScore: 0.123\n\n> qqqqqqqqqq\n> second\n(1 more)\n"
