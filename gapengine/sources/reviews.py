"""Review tables: CSV and Parquet with columns that are found by alias."""

from __future__ import annotations

from pathlib import PurePosixPath
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapengine.functions.text import canonical

#: Accepted column names, in order of precedence.
ALIASES = {
    "package": ("package_name", "package", "app_id"), "text": ("review", "review_text", "text", "content"), "rating": ("star", "stars", "rating", "score"),
    "time": ("date", "timestamp", "created_at", "review_date"), "source_id": ("id", "review_id"), "version": ("version_id", "version", "app_version"),
}
REQUIRED = ("package", "text")
MAX_ROWS, MAX_ROW_CHARS, MAX_CHARS = 1_000_000, 100_000, 128 << 20


def safe_path(path: str, schemes=("", "file", "hdfs", "s3a", "gs", "abfss", "viewfs", "dbfs")) -> str:
    """Rejects network shares, devices and unknown schemes; whether the file is there is for the reader to say."""
    if path.startswith(("\\\\", "//", "\\\\?\\")) or "\x00" in path:
        raise ValueError("network and device paths aren't read")
    scheme = urlsplit(path).scheme
    if (scheme not in schemes and len(scheme) > 1) or PurePosixPath(urlsplit(path).path).parts[:2] == ("/", "dev"):
        raise ValueError(f"paths of the kind {scheme or 'device'} aren't read")
    return path


def resolve(columns: list[str]) -> dict[str, str]:
    """Canonical name to actual column: the first alias that a column has, in any case and with any white space."""
    known = {}
    for c in columns:
        known.setdefault(" ".join(c.split()).casefold(), c)
    out = {name: known[a] for name, alias in ALIASES.items() for a in reversed(alias) if a in known}
    if missing := [x for x in REQUIRED if x not in out]:
        raise ValueError(f"no column for {', '.join(missing)}")
    return out


def read(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """(package, text, rating, time, source_id, version) as strings; columns that a file lacks are null. Only the columns that are needed are read."""
    safe_path(path)
    kind = kind or ("csv" if path.lower().endswith((".csv", ".csv.gz")) else "parquet")
    if kind == "csv":
        raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
        raw = raw.toDF(*[c.lstrip("\ufeff") for c in raw.columns])
    else:
        raw = spark.read.parquet(path)
    own = resolve(raw.columns)
    return raw.select(*[(F.col(f"`{own[k]}`").cast("string") if k in own else F.lit(None).cast("string")).alias(k) for k in ALIASES])


def limits(rows: DataFrame) -> DataFrame:
    """(check, value, limit) of the input limits that are exceeded; one aggregation."""
    n = F.coalesce(F.length("text"), F.lit(0))
    seen = rows.agg(F.count("*").alias("rows"), F.coalesce(F.max(n), F.lit(0)).cast("long").alias("row_chars"), F.coalesce(F.sum(n), F.lit(0)).alias("chars"))
    out = seen.unpivot([], ["rows", "row_chars", "chars"], "check", "value")
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in {"rows": MAX_ROWS, "row_chars": MAX_ROW_CHARS, "chars": MAX_CHARS}.items() for x in kv]), F.col("check"))
    return out.withColumn("limit", limit.cast("long")).where("value > limit")


def corpus_facts(rows: DataFrame, package: str) -> DataFrame:
    """One row to verify a fetched corpus with: rows, rows of the package, distinct packages."""
    key = F.lower(canonical(F.col("package")))
    return rows.groupBy(key.alias("p")).agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("p") == package.lower(), F.col("n"))), F.lit(0)).alias("package_rows"), F.count("p").alias("packages"))
