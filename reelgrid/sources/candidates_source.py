"""Python data source ``saved_candidates``: candidates from saved API responses."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "platform string, item string"


class _File(InputPartition):
    def __init__(self, path: str, platform: str):
        self.path, self.platform = path, platform


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.platform = options.get("platform", "")

    def partitions(self) -> list[_File]:
        out = []
        for platform in sorted(os.listdir(self.root)):
            folder = os.path.join(self.root, platform)
            if os.path.isdir(folder) and self.platform in ("", platform):
                out += [_File(os.path.join(folder, f), platform) for f in sorted(os.listdir(folder)) if f.endswith((".json", ".jsonl"))]
        return out

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, encoding="utf-8") as f:
            for line in f:
                line = line.strip()
                if not line:
                    continue
                try:
                    json.loads(line)
                except ValueError:
                    continue
                yield partition.platform, line


class SavedCandidates(DataSource):
    """``<path>/<platform>/*.jsonl`` of saved items, one task per file.

    ``spark.dataSource.register(SavedCandidates)`` then
    ``spark.read.format("saved_candidates").load(path)``; the rows go through
    ``to_candidates`` per platform.
    """

    @classmethod
    def name(cls) -> str:
        return "saved_candidates"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options)
