"""Backlogs from a code forge: JSON fixtures, and a Python data source that pages through an API.

The data source takes its transport by name, so that it runs without a network in tests; each endpoint is one partition.
"""

from __future__ import annotations

import importlib
import json
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gapengine.functions.numbers import parse_datetime

USER = "struct<title:string,number:int,due_on:string>"
ISSUE = f"number int, title string, body string, state string, state_reason string, labels array<string>, milestone {USER}, created_at string, updated_at string, closed_at string, html_url string, pull_request string"
MILESTONE = "number int, title string, description string, state string, created_at string, updated_at string, closed_at string, due_on string, html_url string"
MAX_PAGES, MAX_ITEMS, MAX_BYTES = 1_000, 100_000, 256 << 20


def label_text(labels) -> list[str]:
    """Names of labels that are strings or objects."""
    return [x if isinstance(x, str) else x.get("name", "") for x in labels or []]


def flat(record: dict) -> dict:
    """An API record with plain labels and the pull request as text."""
    out = dict(record)
    if "labels" in out:
        out["labels"] = label_text(out["labels"])
    if out.get("pull_request") is not None:
        out["pull_request"] = json.dumps(out["pull_request"])
    return out


def fixture(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame, dict]:
    """Issues, milestones and the other fields of fixture files: combined objects, or lists in files named milestones* and issues*. Fixtures are small files of the driver."""
    from gapengine.sources.artifacts import strict_json

    issues, milestones, rest = [], [], {}
    for p in paths:
        data = strict_json(p)
        if isinstance(data, dict):
            issues += data.get("issues", [])
            milestones += data.get("milestones", [])
            rest |= {k: v for k, v in data.items() if k not in ("issues", "milestones")}
        elif re.search(r"milestones[^/]*$", p):
            milestones += data
        else:
            issues += data
    return (*tables(_rows(spark, issues, ISSUE), _rows(spark, milestones, MILESTONE)), rest)


def _rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    text = spark.createDataFrame([(json.dumps(flat(r)),) for r in rows], "t string")
    return text.select(F.from_json("t", schema).alias("x")).select("x.*")


def tables(issues: DataFrame, milestones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As operators.ingest.roadmap() takes them."""
    ts = lambda c: parse_datetime(F.col(c)).alias(c.split(".")[-1])
    i = issues.select("number", "title", "body", "state", "state_reason", "labels", F.col("milestone.title").alias("milestone"), F.col("milestone.number").alias("milestone_number"), parse_datetime(F.col("milestone.due_on")).alias("milestone_due"), ts("created_at"), ts("updated_at"), ts("closed_at"), "html_url", "pull_request")
    m = milestones.select("number", "title", F.col("description").alias("body"), "state", parse_datetime(F.col("due_on")).alias("due"), ts("created_at"), ts("updated_at"), ts("closed_at"), "html_url")
    return i, m


def next_page(link: str | None) -> str | None:
    """The address of rel=next in a Link header."""
    for part in (link or "").split(","):
        if m := re.match(r'\s*<([^>]+)>\s*;.*rel="?next"?', part):
            return m[1]
    return None


def rate_limited(status: int, headers: dict) -> str | None:
    """What to tell the user of an answer that a rate limit caused; None of other answers."""
    if status not in (403, 429) or (headers.get("x-ratelimit-remaining") != "0" and "retry-after" not in headers):
        return None
    when = headers.get("retry-after") or headers.get("x-ratelimit-reset")
    return f"the forge's rate limit is used up; try again {'after ' + when + ' s' if 'retry-after' in headers else 'at ' + str(when) if when else 'later'}, or with a token"


def web_fetch(url: str, transport, token: str | None = None, origin: str | None = None) -> tuple[list[dict], str | None]:
    """(records, Link header) of one page. transport(url, headers) -> (status, headers with lower-case names, body). The token goes to its own origin only."""
    headers = {"accept": "application/json"}
    if token and origin and urlsplit(url)[:2] == urlsplit(origin)[:2] and urlsplit(url).scheme == "https":
        headers["authorization"] = f"Bearer {token}"
    status, got, body = transport(url, headers)
    if said := rate_limited(status, got):
        raise PermissionError(said)
    if status in (401, 403):
        raise PermissionError("the forge doesn't accept the token")
    if status != 200:
        raise ValueError(f"the forge answered {status}")
    if len(body) > MAX_BYTES:
        raise ValueError("a page is too large")
    rows = json.loads(body)
    if not isinstance(rows, list):
        raise ValueError("a page isn't a list")
    return rows, got.get("link")


def pages(fetch, url: str, max_pages: int = MAX_PAGES, max_items: int = MAX_ITEMS) -> Iterator[list[dict]]:
    """Pages of a listing. fetch(url) -> (records, Link header). Loops, other origins and too many pages or items are errors."""
    origin, seen, items = urlsplit(url)[:2], set(), 0
    while url:
        if url in seen:
            raise ValueError("the pages form a loop")
        if urlsplit(url)[:2] != origin:
            raise ValueError("the next page is on another server")
        if len(seen) >= max_pages:
            raise ValueError("too many pages")
        seen.add(url)
        rows, link = fetch(url)
        items += len(rows)
        if items > max_items:
            raise ValueError("too many items")
        yield rows
        url = next_page(link)


class Endpoint(InputPartition):
    def __init__(self, kind: str, url: str):
        self.kind, self.url = kind, url


class ForgeSource(DataSource):
    """spark.read.format("forge").option("base", url).option("repository", "owner/name").option("transport", "module:function").option("state", "open|all").load(): (kind, record as JSON)."""

    @classmethod
    def name(cls) -> str:
        return "forge"

    def schema(self) -> str:
        return "kind string, record string"

    def reader(self, schema) -> DataSourceReader:
        return ForgeReader(dict(self.options))


class ForgeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        if not re.fullmatch(r"[\w.-]+/[\w.-]+", options["repository"]):
            raise ValueError("a repository is owner/name")

    def partitions(self) -> list[Endpoint]:
        base, state = self.options["base"].rstrip("/"), self.options.get("state", "open")
        return [Endpoint(k, f"{base}/repos/{self.options['repository']}/{k}?state={state}&per_page=100") for k in ("milestones", "issues")]

    def read(self, partition: Endpoint) -> Iterator[tuple]:
        module, _, name = self.options["transport"].partition(":")
        fetch = getattr(importlib.import_module(module), name)
        for rows in pages(fetch, partition.url):
            for r in rows:
                yield partition.kind, json.dumps(flat(r))


def from_source(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables of a forge source's rows."""
    one = lambda kind, schema: df.where(F.col("kind") == kind).select(F.from_json("record", schema).alias("x")).select("x.*")
    return tables(one("issues", ISSUE), one("milestones", MILESTONE))
