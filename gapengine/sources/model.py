"""A client of a language model that the caller brings: answers are cached, failures retried, calls spaced; offline, a stub of the schema answers."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from gapengine.sources.artifacts import atomic_json, strict_json


def stub(schema: dict):
    """The least value of a JSON schema: what an offline run answers with."""
    if "enum" in schema:
        return schema["enum"][0]
    kind = schema.get("type")
    if kind == "object":
        return {k: stub(v) for k, v in schema.get("properties", {}).items()}
    return {"array": [], "string": "", "integer": 0, "number": 0.0, "boolean": False}.get(kind)


@dataclass
class Client:
    """transport(prompt, schema) -> answer; None: offline. Samples of one prompt are cached apart, by their number."""

    transport: Callable[[str, dict], object] | None = None
    folder: Path | None = None
    retries: int = 3
    interval: float = 0.0
    wait: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic
    calls: int = 0
    failures: int = 0
    last: float = field(default=float("-inf"))

    def ask(self, prompt: str, schema: dict, sample: int = 0):
        """One answer. An answer that isn't JSON, or a transport that fails as often as it may, raises what the transport raised last."""
        if self.transport is None:
            return stub(schema)
        key = hashlib.sha256(json.dumps([prompt, schema, sample], sort_keys=True).encode()).hexdigest()
        path = Path(self.folder) / f"{key}.json" if self.folder else None
        if path and path.is_file():
            return strict_json(path)
        for attempt in range(self.retries + 1):
            if (pause := self.last + self.interval - self.clock()) > 0:
                self.wait(pause)
            self.last = self.clock()
            self.calls += 1
            try:
                answer = self.transport(prompt, schema)
                json.dumps(answer, allow_nan=False)
                break
            except Exception:
                self.failures += 1
                if attempt == self.retries:
                    raise
                self.wait(2.0**attempt)
        if path:
            atomic_json(path, answer)
        return answer
