"""An append-only log of entries in parts, and a streaming source that reads it for a consumer group.

The log is a table of Parquet files, a folder a part, each entry with its part's next offset. The source reads ranges of offsets
and prunes files by their statistics. A group's position is acknowledged after a batch's outcome is written: by Spark, when it commits
the batch before it plans the next, or by the consumer at once; a reader of that group with a new checkpoint starts there, one with its old checkpoint where that says.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from loomline.functions.shipping import ship
from loomline.operators.order import dense_order

ENTRY = "part int, offset bigint, body string"
#: Row groups of the log's files: a reader takes the groups that its range meets, one at a time, so they are small.
GROUP_BYTES = 4 << 20
_ARROW = pa.schema([("part", pa.int32()), ("offset", pa.int64()), ("body", pa.string())])


def append_log(entries: DataFrame, path: str, parts: int, key: Column, order: list[str], body: Column) -> None:
    """Append ``entries`` in ``order`` (which has no ties) to the log; the entries of a key are in one part, in that order.

    Offsets go on from each part's end. A part may hold any share of the entries: numbering and writing go by ranges of
    (part, order), not by part. Only one writer at a time.
    """
    spark = entries.sparkSession
    keyed = entries.select(F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part"), *order, body.alias("body"))
    placed = dense_order(keyed, ["part", *order], "at")
    # one row a part: its first place among the new entries, and the offset that this place gets
    starts = placed.groupBy("part").agg(F.min("at").alias("first"))
    ends = _ends(path)
    known = F.create_map(*[F.lit(x) for kv in ends.items() for x in kv]) if ends else F.create_map().cast("map<int,bigint>")
    rows = placed.join(F.broadcast(starts), "part").withColumn("offset", F.col("at") - F.col("first") + F.coalesce(F.try_element_at(known, "part"), F.lit(0)))
    rows.select("part", "offset", "body").sortWithinPartitions("part", "offset").write.mode("append").option("parquet.block.size", GROUP_BYTES).partitionBy("part").parquet(path)
    ship(spark)


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)


class _Files:
    """The ranges of offsets that a log's files hold; a file's footer is read once."""

    def __init__(self, path: str):
        self.fs, self.root = _open(path)
        self.ranges: dict[str, tuple[int, int, int]] = {}

    def refresh(self) -> dict[int, list[tuple[int, int, str]]]:
        for f in self.fs.get_file_info(pafs.FileSelector(self.root, recursive=True, allow_not_found=True)):
            folder = posixpath.basename(posixpath.dirname(f.path))
            if f.path in self.ranges or not folder.startswith("part=") or not f.base_name.endswith(".parquet") or f.base_name[0] in "._":
                continue
            footer = ds.ParquetFileFormat().make_fragment(f.path, self.fs).metadata
            at = footer.schema.names.index("offset")
            groups = [footer.row_group(k).column(at).statistics for k in range(footer.num_row_groups)]
            if groups:
                self.ranges[f.path] = (int(folder[5:]), min(g.min for g in groups), max(g.max for g in groups) + 1)
        out: dict[int, list] = {}
        for path, (part, lo, hi) in self.ranges.items():
            out.setdefault(part, []).append((lo, hi, path))
        return {p: sorted(files) for p, files in out.items()}

    def ends(self) -> dict[int, int]:
        """Each part's end: offsets up to the first gap, as a writer's files may appear in any order."""
        out = {}
        for part, files in self.refresh().items():
            end = 0
            for lo, hi, _ in files:
                if lo > end:
                    break
                end = max(end, hi)
            out[part] = end
        return out


def _ends(path: str) -> dict[int, int]:
    return _Files(path).ends()


class _Range(InputPartition):
    def __init__(self, part: int, lo: int, hi: int, files: list[str]):
        self.part, self.lo, self.hi, self.files = part, lo, hi, files


class _GroupReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.group = options["path"], options["group"]
        self.most = int(options.get("maxentries", 0))
        self.chunk = int(options.get("chunk", 100_000))
        self.files, self.sent = _Files(self.path), None

    def initialOffset(self) -> dict:
        return acknowledged(self.path, self.group)

    def latestOffset(self) -> dict:
        ends = self.files.ends()
        if self.sent is None:
            self.sent = self.initialOffset()
        upto = {str(p): min(end, self.sent.get(str(p), 0) + self.most) if self.most else end for p, end in ends.items()}
        return {p: max(end, self.sent.get(p, 0)) for p, end in upto.items()}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        self.sent, files, out = end, self.files.refresh(), []
        for p, hi in end.items():
            for lo in range(start.get(p, 0), hi, self.chunk):
                upto = min(hi, lo + self.chunk)
                out.append(_Range(int(p), lo, upto, [f for a, b, f in files.get(int(p), []) if a < upto and b > lo]))
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(self.path)
        for path in partition.files:
            with fs.open_input_file(path) as opened:
                file = pq.ParquetFile(opened, pre_buffer=False, memory_map=False)
                at = file.schema_arrow.get_field_index("offset")
                for k in range(file.num_row_groups):
                    seen = file.metadata.row_group(k).column(at).statistics
                    if seen.max < partition.lo or seen.min >= partition.hi:
                        continue
                    for b in file.iter_batches(10_000, row_groups=[k], columns=["offset", "body"], use_threads=False):
                        b = b.filter((pc.field("offset") >= partition.lo) & (pc.field("offset") < partition.hi))
                        if b.num_rows:
                            yield pa.RecordBatch.from_arrays([pa.array([partition.part] * b.num_rows, pa.int32()), b.column(0), b.column(1)], schema=_ARROW)

    def commit(self, end: dict) -> None:
        acknowledge(self.path, self.group, end)


class GroupLog(DataSource):
    """``spark.readStream.format("group_log")`` with options path, group, maxEntries (of a part in a batch; none without it) and chunk (entries a task)."""

    @classmethod
    def name(cls) -> str:
        return "group_log"

    def schema(self) -> str:
        return ENTRY

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _GroupReader({k.lower(): v for k, v in dict(self.options).items()})


def acknowledged(path: str, group: str) -> dict[str, int]:
    """part -> the offset up to which the group has finished."""
    fs, root = _open(path)
    at = f"{root}/_groups/{group}.json"
    if fs.get_file_info(at).type == pafs.FileType.NotFound:
        return {}
    with fs.open_input_stream(at) as f:
        return json.loads(f.read())


def acknowledge(path: str, group: str, ends: dict[str, int]) -> None:
    """All entries before ``ends`` (part -> offset) are finished. A position never goes back."""
    done = acknowledged(path, group)
    done |= {p: max(n, done.get(p, 0)) for p, n in ends.items()}
    fs, root = _open(path)
    target = f"{root}/_groups/{group}.json"
    fs.create_dir(posixpath.dirname(target), recursive=True)
    with fs.open_output_stream(f"{target}.new") as out:
        out.write(json.dumps(done).encode())
    fs.move(f"{target}.new", target)


def read_group(spark: SparkSession, path: str, group: str, most: int = 0, chunk: int = 100_000) -> DataFrame:
    """The log as a stream of (part, offset, body) for a group. The path is one that pyarrow opens: a local folder, hdfs, s3 or gs."""
    ship(spark)
    spark.dataSource.register(GroupLog)
    return spark.readStream.format("group_log").option("path", path).option("group", group).option("maxEntries", most).option("chunk", chunk).load()
