"""A job's log as a streaming data source whose offsets are sequence numbers.

The log is a folder of Parquet files of log rows (job_id, seq, payload), as streams append them, with partition folders or without. A file's statistics say
which numbers it holds; the log reaches as far as no number is missing, so a batch that is still being written is not served in part.
Spark keeps the offset in the query's checkpoint: a restart goes on behind the last number that was served, and option
`from` replays what follows any number. Each range of an offset is planned as one partition a file.

    spark.dataSource.register(JobLog)
    spark.readStream.format("job_log").option("path", folder).option("job", 7).option("from", 0).load()
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "job_id long, seq long, payload string"


class Range(InputPartition):
    """The rows of one file with numbers in (low, high]."""

    def __init__(self, path: str, job: int, low: int, high: int) -> None:
        self.path, self.job, self.low, self.high = path, job, low, high


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def log_files(path: str, job: int) -> list[tuple[str, int, int, int]]:
    """path, least number, largest number and rows of the files that hold rows of a job, by largest number."""
    system, root = opened(path)
    out = []
    for info in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        hidden = any(p.startswith((".", "_")) for p in info.path[len(root) :].split("/"))
        if info.type != fs.FileType.File or not info.path.endswith(".parquet") or hidden or f"/job_id={job}/" not in info.path and "/job_id=" in info.path:
            continue
        seqs = read_rows(system, info.path, job, 0, 1 << 62, ["seq"]).column("seq")
        if len(seqs):
            ends = pc.min_max(seqs)
            out.append((info.path, ends["min"].as_py(), ends["max"].as_py(), len(seqs)))
    return sorted(out, key=lambda f: f[2])


def read_rows(system: fs.FileSystem, path: str, job: int, low: int, high: int, columns: list[str]) -> pa.Table:
    """Rows of a job with numbers in (low, high], in order; row groups without any are not read."""
    with system.open_input_file(path) as f:
        file = pq.ParquetFile(f)
        names = file.schema_arrow.names
        at = names.index("seq")
        groups = []
        for i in range(file.num_row_groups):
            s = file.metadata.row_group(i).column(at).statistics
            if s is None or not s.has_min_max or s.max > low and s.min <= high:
                groups.append(i)
        rows = file.read_row_groups(groups, [c for c in dict.fromkeys(["job_id", "seq", *columns]) if c in names])
    keep = pc.and_(pc.greater(rows["seq"], low), pc.less_equal(rows["seq"], high))
    if "job_id" in rows.column_names:
        keep = pc.and_(keep, pc.equal(rows["job_id"], job))
    return rows.filter(keep).sort_by("seq").select(columns)


class JobLogReader(DataSourceStreamReader):
    def __init__(self, path: str, job: int, after: int) -> None:
        self.path, self.job, self.after = path, job, after

    def initialOffset(self) -> dict:
        return {"seq": self.after}

    def latestOffset(self) -> dict:
        # As far as no number is missing: the rows of the files up to there are as many as their numbers.
        reached, rows = self.after, 0
        for _, _, last, n in log_files(self.path, self.job):
            rows += n
            if rows == last:
                reached = max(reached, last)
        return {"seq": reached}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        low, high = start["seq"], end["seq"]
        return [Range(path, self.job, low, high) for path, least, last, _ in log_files(self.path, self.job) if last > low and least <= high]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        rows = read_rows(system, partition.path, partition.job, partition.low, partition.high, ["seq", "payload"])
        held = pa.table({"job_id": pa.array([partition.job] * len(rows), pa.int64()), "seq": rows["seq"].cast(pa.int64()), "payload": rows["payload"].cast(pa.string())})
        yield from held.to_batches()

    def commit(self, end: dict) -> None:
        pass  # the log keeps what was served, for other viewers


class JobLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "job_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> JobLogReader:  # noqa: ANN001
        return JobLogReader(self.options["path"], int(self.options["job"]), int(self.options.get("from", 0)))
