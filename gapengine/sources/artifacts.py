"""JSON artifacts: strict reading, keyed envelopes, atomic writing, content digests."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 64 << 20


def _unique(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a JSON object repeats a key")
    return out


def _no_constant(name: str):
    raise ValueError(f"{name} isn't JSON")


def strict_json(path: str | Path, root: str | Path | None = None):
    """A small JSON document of the driver: no repeated keys, no NaN, no links, no path outside root, at most MAX_BYTES."""
    p = Path(path)
    if p.is_symlink():
        raise ValueError("links aren't followed")
    if root is not None and not p.resolve().is_relative_to(Path(root).resolve()):
        raise ValueError("the path leaves its folder")
    if p.stat().st_size > MAX_BYTES:
        raise ValueError("the document is too large")
    return json.loads(p.read_text("utf-8-sig"), object_pairs_hook=_unique, parse_constant=_no_constant)


def atomic_json(path: str | Path, value) -> None:
    """Sorted keys, one rename; NaN is refused."""
    text = json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False, allow_nan=False) + "\n"
    p = Path(path)
    fd, tmp = tempfile.mkstemp(dir=p.parent, prefix=f".{p.name}.")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, p)
    except BaseException:
        Path(tmp).unlink(missing_ok=True)
        raise


def records(spark: SparkSession, path: str, schema: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a JSON file that is a list, or an object that holds the list under one of keys. schema: of one record.

    JSON lines are read as they are; whole documents are parsed by Spark.
    """
    if path.endswith((".jsonl", ".ndjson")):
        return spark.read.schema(schema).json(path)
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\ufeff", "").alias("t"))
    bare = F.from_json("t", f"array<struct<{_struct(schema)}>>")
    wrapped = [F.from_json("t", f"struct<`{k}`: array<struct<{_struct(schema)}>>>")[k] for k in keys]
    is_list = F.ltrim("t").startswith("[")
    found = F.when(is_list, bare).otherwise(F.coalesce(*wrapped) if wrapped else F.lit(None))
    return text.select(F.inline(found))


def _struct(schema: str) -> str:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).simpleString()[len("struct<") : -1]


def canonical(value):
    """Keys sorted at every level; lists keep their order."""
    if isinstance(value, dict):
        return {k: canonical(value[k]) for k in sorted(value)}
    return [canonical(x) for x in value] if isinstance(value, list) else value


def sha256_file(path: str | Path) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def contract_hash(values: dict) -> str:
    return hashlib.sha256(json.dumps(canonical(values), separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def validated(manifest: dict, folder: str | Path, unique: dict[str, str]) -> list[str]:
    """Problems of a run's artifacts: digests that the manifest declares and files don't have, missing files, ids that are empty or repeat. unique: file name to id field."""
    out = []
    for name, digest in sorted(manifest.get("artifacts", {}).items()):
        p = Path(folder) / name
        if not p.is_file():
            out.append(f"{name} is missing")
        elif sha256_file(p) != digest:
            out.append(f"{name} has changed")
        elif name in unique:
            rows = strict_json(p, folder)
            ids = [r.get(unique[name]) for r in (rows if isinstance(rows, list) else next((v for v in rows.values() if isinstance(v, list)), []))]
            if not all(ids) or len(set(ids)) < len(ids):
                out.append(f"{name} has empty or repeated ids")
    return out


def stale(recorded: dict[str, str], current: dict[str, str]) -> list[str]:
    """Inputs whose digest isn't the recorded one; what was never recorded counts as stale."""
    return sorted(k for k in {*recorded, *current} if not recorded.get(k) or recorded.get(k) != current.get(k))
