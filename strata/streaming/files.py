"""Files of a project as a stream of what appears, changes and goes."""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.tables import CODE_EXTENSIONS, SKIPPED_FOLDERS

#: Changes that one partition holds.
CHANGES = 1000


def listing(root: str, extensions: tuple[str, ...], skipped: tuple[str, ...]) -> dict[str, list[int]]:
    """path -> [bytes, time of change in ns] of the files below a folder of any store that Arrow knows."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
    never = re.compile("/(" + "|".join(map(re.escape, skipped)) + ")/")
    out = {}
    for f in store.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=True)):
        below = f.path[len(base.rstrip("/")) :]
        if f.type == fs.FileType.File and (not extensions or f.path.lower().endswith(extensions)) and not never.search(below):
            out[f.path] = [f.size, f.mtime_ns or 0]
    return out


def differences(before: dict[str, list[int]], after: dict[str, list[int]], at_ms: int) -> list[tuple[str, str, int, int]]:
    """(type, path, bytes, ms) in order of the paths; what goes has the time at which that was seen."""
    out = []
    for path in sorted(before.keys() | after.keys()):
        if path not in after:
            out.append(("unlink", path, before[path][0], at_ms))
        elif before.get(path) != after[path]:
            out.append(("change" if path in before else "add", path, after[path][0], after[path][1] // 1_000_000))
    return out


class Changes(InputPartition):
    def __init__(self, rows: list[tuple[str, str, int, int]]):
        self.rows = rows


class FolderReader(DataSourceStreamReader):
    """An offset is a listing of the folder, and a batch the difference of two: it is the same whenever it is read again."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.extensions = tuple(x for x in options.get("extensions", "").split(",") if x)
        self.skipped = tuple(x for x in options.get("skipped", "").split(",") if x)
        self.existing = options.get("existing", "true").lower() == "true"
        self.last: dict | None = None

    def now(self) -> dict:
        return {"at": int(time.time() * 1000), "files": dict(sorted(listing(self.root, self.extensions, self.skipped).items()))}

    def initialOffset(self) -> dict:
        return {"at": 0, "files": {}} if self.existing else self.now()

    def latestOffset(self) -> dict:
        found = self.now()
        if self.last is None or self.last["files"] != found["files"]:
            self.last = found
        return self.last

    def partitions(self, start: dict, end: dict) -> list[Changes]:
        rows = differences(start["files"], end["files"], end["at"])
        return [Changes(rows[k : k + CHANGES]) for k in range(0, len(rows), CHANGES)]

    def read(self, partition: Changes) -> Iterator[tuple]:
        for kind, path, size, ms in partition.rows:
            yield kind, path, size, ms, datetime.fromtimestamp(ms / 1000, UTC)


class FolderChanges(DataSource):
    """``spark.readStream.format("folder_changes")``, with the options path, extensions, skipped and existing."""

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return "type string, path string, bytes long, atMs long, at timestamp"

    def streamReader(self, schema) -> FolderReader:
        return FolderReader(dict(self.options))


def watch_files(spark: SparkSession, root: str, project: str, branch: str = "main", extensions: tuple[str, ...] = CODE_EXTENSIONS, existing: bool = True) -> DataFrame:
    """File events (projectId, branch, eventId, atMs, at, type, path, bytes) of code under ``root``, for the suggestion stream.

    ``add``, ``change`` and ``unlink`` are told by comparing listings, so what happens while no query runs is told when
    it is started again; a file that changes twice between two listings is told once. Without ``existing``, files
    that are there at the first start aren't told. The listing, about 100 bytes a file, is kept as the offset. Folders
    that are never read and other files are left out.
    """
    spark.dataSource.register(FolderChanges)
    raw = spark.readStream.format("folder_changes").options(path=root, extensions=",".join(extensions), skipped=",".join(SKIPPED_FOLDERS), existing=str(existing).lower()).load()
    return raw.select(F.lit(project).alias("projectId"), F.lit(branch).alias("branch"), F.xxhash64("type", "path", "atMs").alias("eventId"), "atMs", "at", "type", "path", "bytes")


def latest_files(events: DataFrame) -> DataFrame:
    """(projectId, branch, path, bytes, atMs) of the files that are there after these events; of one moment an addition
    counts after a removal."""
    last = F.max_by(F.struct("type", "bytes", "atMs"), F.struct("atMs", (F.col("type") != "unlink").cast("int")))
    return events.groupBy("projectId", "branch", "path").agg(last.alias("l")).where("l.type <> 'unlink'").select("projectId", "branch", "path", "l.bytes", "l.atMs")
