"""What travels when members are grounded."""

from __future__ import annotations

import re

from gapengine.operators import needs


def test_tokens_are_not_exchanged_by_cluster(spark, capsys):
    members = spark.createDataFrame([(1, "c", ["a", "x"], "t"), (2, "c", ["y"], "t"), (3, "d", ["y"], "t"), (4, "e", None, "t"), (5, "e", ["b"], "t"), (6, "f", ["a"], "t")], "id long, cluster string, tokens array<string>, text string")
    domains = spark.createDataFrame([("one", "a"), ("two", "b")], "domain string, word string")
    matches = spark.createDataFrame([("c", "one"), ("d", "one"), ("e", "two")], "cluster string, domain string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = needs.grounded(members, matches, domains, "cluster")
        out.select("cluster", "id").explain("formatted")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sent = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", capsys.readouterr().out)
    assert len(sent) > 2 and not [x for x in sent if "tokens" in x]
    assert sorted(r.id for r in out.collect()) == [1, 3, 5, 6] and set(out.columns) == set(members.columns)
