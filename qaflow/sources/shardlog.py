"""An append-only row log as a Spark data source: ``spark.dataSource.register(ShardLog)``, then format ``shardlog``.

Tasks write Parquet files; a commit is one line that names them. A row's number is its place among all committed rows, and a
shard is ``rowsPerShard`` numbers in a row, so shards have an exact size and the last one is filled up by the next append
without ranking rows or rewriting files. Reads are planned as shards: of one rank out of several, and from an offset on.

Shards may be small and many: a task that has filled a few files of a shard's rows makes each next one as large as those before
together, and a partition takes several shards in a row once there are more than ``PARTITIONS`` of them.
"""

from __future__ import annotations

import json
import time
import uuid
from bisect import bisect_right
from dataclasses import dataclass, field
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

ROWS_PER_SHARD = 200_000
#: Files of a shard's rows that a task writes before larger ones, and the rows of these at most.
SINGLE_FILES, ROWS_PER_FILE = 16, 1_000_000
#: Partitions of a read that may be single shards; of more shards several in a row share one, ``ROWS_PER_SHARD`` rows at most.
PARTITIONS = 200


class LogConflict(RuntimeError):
    """Another writer has taken the same place in the log."""


class Folder:
    """The files of one log, on any file system that Arrow can open."""

    def __init__(self, path: str) -> None:
        self.system, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        self.root = root.rstrip("/")

    def entries(self) -> list[dict]:
        """Commits in order: {"transaction", "rowsPerShard", "files": [[name, rows], ...]}."""
        found = self.system.get_file_info(fs.FileSelector(f"{self.root}/log", allow_not_found=True))
        names = sorted(x.path for x in found if x.base_name.endswith(".json"))
        return [json.loads(self.read(name)) for name in names]

    def read(self, name: str) -> bytes:
        with self.system.open_input_stream(name) as file:
            return file.read()

    def append(self, entry: dict, number: int) -> None:
        """Write the commit of a number; LogConflict if it is taken."""
        place, draft = f"{self.root}/log/{number:09d}.json", f"{self.root}/log/.{uuid.uuid4().hex}"
        self.system.create_dir(f"{self.root}/log", recursive=True)
        if isinstance(self.system, fs.LocalFileSystem):
            try:
                with open(place, "x") as file:  # created only if it is not there
                    file.write(json.dumps(entry))
            except FileExistsError as e:
                raise LogConflict(place) from e
            return
        with self.system.open_output_stream(draft) as out:
            out.write(json.dumps(entry).encode())
        if self.system.get_file_info(place).type != fs.FileType.NotFound:
            self.system.delete_file(draft)
            raise LogConflict(place)
        self.system.move(draft, place)

    def drop_job(self, job: str, keep: set[str] = frozenset()) -> None:
        """Delete what a job has written, but for the files in ``keep``."""
        base = f"{self.root}/data/{job}"
        for info in self.system.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            if f"{job}/{info.base_name}" not in keep:
                self.system.delete_file(info.path)
        if not keep and self.system.get_file_info(base).type != fs.FileType.NotFound:
            self.system.delete_dir(base)


    def vacuum(self, older_than: float = 86_400.0) -> int:
        """Delete files that no commit names and that are older than so many seconds; the number of files deleted.

        A task that was still running when its job was given up may leave such files. The age keeps those of running jobs.
        """
        named = {name for e in self.entries() for name, _ in e["files"]}
        gone = 0
        for info in self.system.get_file_info(fs.FileSelector(f"{self.root}/data", allow_not_found=True, recursive=True)):
            if info.type == fs.FileType.File and time.time() - info.mtime_ns / 1e9 >= older_than and "/".join(info.path.split("/")[-2:]) not in named:
                self.system.delete_file(info.path)
                gone += 1
        return gone


@dataclass
class Written(WriterCommitMessage):
    partition: int
    files: list[tuple[str, int]]


class ShardWriter(DataSourceArrowWriter):
    """Each attempt of a task writes files of its own; only those that its message names are committed."""

    def __init__(self, options: dict, schema) -> None:
        self.path, self.rows = options["path"], int(options.get("rowsPerShard", ROWS_PER_SHARD))
        self.job = uuid.uuid4().hex
        self.transaction = options.get("transaction", self.job)
        self.schema = to_arrow_schema(schema)

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        context, folder = TaskContext.get(), Folder(self.path)
        partition, done, writer, held, most = context.partitionId(), [], None, 0, self.rows
        folder.system.create_dir(f"{folder.root}/data/{self.job}", recursive=True)

        def close() -> None:
            nonlocal writer, held, most
            if writer is not None:
                writer.close()
                done.append((name, held))
                writer, held = None, 0
                if len(done) >= SINGLE_FILES:
                    most = max(self.rows, min(sum(n for _, n in done), ROWS_PER_FILE))

        for batch in iterator:
            while len(batch):
                if writer is None:
                    name = f"{self.job}/part-{partition:05d}-{context.taskAttemptId()}-{len(done):05d}.parquet"
                    writer = pq.ParquetWriter(f"{folder.root}/data/{name}", self.schema, filesystem=folder.system, compression="zstd")
                part = batch.slice(0, most - held)
                writer.write_batch(part.cast(self.schema))
                held += len(part)
                batch = batch.slice(len(part))
                if held == most:
                    close()
        close()
        return Written(partition, done)

    def commit(self, messages) -> None:
        folder = Folder(self.path)
        files = [f for m in sorted((m for m in messages if m is not None), key=lambda m: m.partition) for f in m.files]
        while True:
            entries = folder.entries()
            if any(e["transaction"] == self.transaction for e in entries):  # a replay of what is there already
                folder.drop_job(self.job)
                return
            if entries and entries[0]["rowsPerShard"] != self.rows:
                folder.drop_job(self.job)
                raise ValueError(f"the log has {entries[0]['rowsPerShard']} rows a shard")
            try:
                folder.append({"transaction": self.transaction, "rowsPerShard": self.rows, "files": files}, len(entries))
            except LogConflict:
                continue  # another writer was first: its rows come before these
            folder.drop_job(self.job, {name for name, _ in files})
            return

    def abort(self, messages) -> None:
        """What the job has written goes; no commit names what a task still writes, and ``Folder.vacuum`` deletes it."""
        Folder(self.path).drop_job(self.job)


@dataclass
class Slices(InputPartition):
    """Rows of one partition: (file, first row, end) in order."""

    value: list[tuple[str, int, int]] = field(default_factory=list)


def slices_between(files: list[tuple[str, int]], first: int, end: int, starts: list[int] | None = None) -> list[tuple[str, int, int]]:
    """Where the rows numbered from ``first`` to before ``end`` lie; ``starts`` are the files' first numbers, for those who ask often."""
    starts = starts or list(accumulate((n for _, n in files), initial=0))
    out = []
    for i in range(max(bisect_right(starts, first) - 1, 0), len(files)):
        if starts[i] >= end:
            break
        name, rows = files[i]
        a, b = max(first - starts[i], 0), min(end - starts[i], rows)
        if a < b:
            out.append((name, a, b))
    return out


def planned(files: list[tuple[str, int]], size: int, first: int, end: int, world: int = 1, rank: int = 0, after: int = 0) -> list[Slices]:
    """Partitions of one shard, or of several in a row if there are many, of ``rank`` among ``world``, from row ``first`` to ``end`` and without the rank's first ``after`` rows."""
    starts = list(accumulate((n for _, n in files), initial=0))
    shards = [s for s in range(first // size, -(-end // size)) if s % world == rank]
    together = max(1, min(-(-len(shards) // PARTITIONS), ROWS_PER_SHARD // size))
    out, seen, room = [], 0, 0
    for shard in shards:
        a, b = max(first, shard * size), min(end, (shard + 1) * size)
        skipped = min(max(after - seen, 0), b - a)
        seen += b - a
        if not (found := slices_between(files, a + skipped, b, starts)):
            continue
        if not room:
            out.append(Slices())
            room = together
        room -= 1
        value = out[-1].value
        if value and value[-1][0] == found[0][0] and value[-1][2] == found[0][1]:
            value[-1] = (found[0][0], value[-1][1], found.pop(0)[2])
        value.extend(found)
    return out


def _read(path: str, schema: pa.Schema, partition: Slices):
    folder = Folder(path)
    for name, slices in groupby(partition.value, key=lambda x: x[0]):
        bounds = np.array([x[1:] for x in slices]).ravel()  # first rows and ends, ascending
        first, end = int(bounds[0]), int(bounds[-1])
        with folder.system.open_input_file(f"{folder.root}/data/{name}") as source:
            file, at, groups, start = pq.ParquetFile(source), 0, [], 0
            for g in range(file.num_row_groups):  # row groups before the first row or after the end are not read
                n = file.metadata.row_group(g).num_rows
                if at < end and at + n > first:
                    groups.append(g)
                    start = at if len(groups) == 1 else start
                at += n
            at = start
            for batch in file.iter_batches(row_groups=groups, columns=schema.names):
                a, b = max(first - at, 0), min(end - at, len(batch))
                if a < b:
                    part = batch.slice(a, b - a)
                    if len(bounds) > 2:  # a row lies in a slice if an odd number of bounds are not above it
                        part = part.filter(pa.array(np.searchsorted(bounds, np.arange(at + a, at + b), "right") % 2 == 1))
                    if len(part):
                        yield part.cast(schema)
                at += len(batch)


class ShardReader(DataSourceReader):
    def __init__(self, options: dict, schema) -> None:
        self.path, self.schema = options["path"], to_arrow_schema(schema)
        self.world, self.rank, self.after = (int(options.get(k, v)) for k, v in (("world", 1), ("rank", 0), ("after", 0)))
        if not 0 <= self.rank < self.world:
            raise ValueError("rank has to lie below world")

    def partitions(self):
        entries = Folder(self.path).entries()
        files = [tuple(f) for e in entries for f in e["files"]]
        size = entries[0]["rowsPerShard"] if entries else 1
        return planned(files, size, 0, sum(n for _, n in files), self.world, self.rank, self.after) or [Slices([])]

    def read(self, partition: Slices):
        return _read(self.path, self.schema, partition)


class ShardStreamReader(DataSourceStreamReader):
    """Offsets are row numbers, so a restart reads the rows after the last one committed."""

    def __init__(self, options: dict, schema) -> None:
        self.path, self.schema = options["path"], to_arrow_schema(schema)

    def initialOffset(self) -> dict:
        return {"row": 0}

    def latestOffset(self) -> dict:
        return {"row": sum(n for e in Folder(self.path).entries() for _, n in e["files"])}

    def partitions(self, start: dict, end: dict):
        entries = Folder(self.path).entries()
        size = entries[0]["rowsPerShard"] if entries else 1
        return planned([tuple(f) for e in entries for f in e["files"]], size, start["row"], end["row"]) or [Slices([])]

    def read(self, partition: Slices):
        return _read(self.path, self.schema, partition)


class ShardLog(DataSource):
    """Options: path; for writing rowsPerShard and transaction (a name under which a write counts once); for reading world, rank, and after."""

    @classmethod
    def name(cls) -> str:
        return "shardlog"

    def schema(self):
        folder = Folder(self.options["path"])
        names = [name for e in folder.entries() for name, _ in e["files"]]
        if not names:
            raise ValueError(f"{self.options['path']} has no rows yet: give a schema")
        with folder.system.open_input_file(f"{folder.root}/data/{names[-1]}") as source:
            return from_arrow_schema(pq.read_schema(source))

    def reader(self, schema) -> ShardReader:
        return ShardReader(self.options, schema)

    def streamReader(self, schema) -> ShardStreamReader:
        return ShardStreamReader(self.options, schema)

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        if overwrite:
            raise ValueError("the log is only appended to")
        return ShardWriter(self.options, schema)
