"""Numbered manifests: small files that name what a version of a table consists of.

A manifest appears whole or not at all, and a number is taken once: it is written under another name and renamed to its
place, which fails where the place is taken. So a reader holds one version however long it reads, and of two writers who
start from one version the second is told. File systems whose rename is no single step (plain object stores) need one
writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from albumetrics.sources.workspace import child_names, drop_path, read_text, rename, write_text


class VersionTaken(RuntimeError):
    """Another writer has published this version."""


class Manifests:
    def __init__(self, spark: SparkSession, root: str):
        self._spark, self.root = spark, root.rstrip("/")

    def numbers(self) -> list[int]:
        names = child_names(self._spark, self.root)
        return sorted(int(n[1:-5]) for n in names if n.startswith("m") and n.endswith(".json"))

    def latest(self, before: int | None = None) -> int | None:
        return max((n for n in self.numbers() if before is None or n < before), default=None)

    def read(self, number: int) -> dict:
        return json.loads(read_text(self._spark, self._path(number)))

    def publish(self, number: int, content: dict, replace: bool = False) -> None:
        """Make ``content`` manifest ``number``; raises ``VersionTaken`` where there is one, unless it may be replaced."""
        draft = f"{self.root}/draft-{uuid.uuid4().hex}"
        write_text(self._spark, draft, json.dumps(content))
        if not rename(self._spark, draft, self._path(number), replace):
            drop_path(self._spark, draft)
            raise VersionTaken(f"version {number} under {self.root} is taken")

    def drop(self, number: int) -> None:
        drop_path(self._spark, self._path(number))

    def _path(self, number: int) -> str:
        return f"{self.root}/m{number}.json"
