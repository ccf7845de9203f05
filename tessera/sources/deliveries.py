"""A streaming source of raw deliveries: files that a receiver drops in a folder, one a request, read once each in order of their names.

spark.readStream.format("deliveries").option("path", folder).load() gives delivery_file, headers (as sent) and body. Names must grow with
arrival, as those of a counter or of a time do; a file must be complete before it gets its name. A file holds a JSON object with headers and the body in
base64. The offset is the last name that was given out, so a restart goes on behind it; files are listed on the driver and read by the tasks.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "delivery_file string, headers map<string,string>, body binary"
#: Files that one task reads. A batch takes all files that are there.
FILES_PER_TASK = 500


def _files(path: str):
    """A file system for the path and the folder in it; any that pyarrow knows by its address."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Names(InputPartition):
    names: list[str]


class DeliveryReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.given: str | None = None

    def _listed(self, after: str) -> list[str]:
        from pyarrow import fs

        system, folder = _files(self.path)
        found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return sorted(f.base_name for f in found if f.is_file and f.base_name > after and f.base_name[0] not in "._")

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        names = self._listed(self.given or "")
        if names:
            self.given = names[-1]
        return {"after": self.given or ""}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.given = max(self.given or "", end["after"])  # after a restart, the batch that was under way comes first
        names = [n for n in self._listed(start["after"]) if n <= end["after"]]
        return [Names(names[at : at + FILES_PER_TASK]) for at in range(0, len(names), FILES_PER_TASK)]

    def read(self, partition: Names) -> Iterator[tuple]:
        system, folder = _files(self.path)
        for name in partition.names:
            with system.open_input_stream(f"{folder.rstrip('/')}/{name}") as stream:
                raw = stream.read()
            try:
                sent = json.loads(raw)
                headers = {str(k): None if v is None else str(v) for k, v in sent["headers"].items()}
                body = base64.b64decode(sent["body"])
            except (ValueError, KeyError, TypeError, AttributeError):
                headers, body = {}, raw  # not a request: it has no signature, so the path below rejects it and keeps it
            yield name, headers, body

    def commit(self, end: dict) -> None:
        pass


class DeliverySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "deliveries"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return DeliveryReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DeliverySource)
