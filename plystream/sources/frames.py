"""Compressed text of any size as a Spark data source: zstd files are split by frames, zip members are streamed.

A zstd file is a row of frames that do not depend on each other. Their places are found by walking the headers of frames and
blocks, which say how long each is, so no byte is decompressed for it, and runs of frames become partitions. A record
begins after a line end that is followed by a marker, such as ``[Event ``, and belongs to the partition that holds this line
end; its task reads on into later frames until the record is complete. A file of one frame is one task, which streams it.
Files are opened by pyarrow's file systems (local, HDFS, S3, GCS). Bytes that are no UTF-8 are replaced.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plystream.sources import files

#: Fixed values of the format: the numbers that frames begin with, and the sizes of a header's fields by its flags.
FRAME, SKIPPABLE = 0xFD2FB528, 0x184D2A50
DICTIONARY, CONTENT = (0, 1, 2, 4), (0, 2, 4, 8)
#: Compressed bytes of a partition, bytes that are read at once, and those of what follows a partition, of which a record's rest is needed.
SPLIT, CHUNK, REST = 64 << 20, 1 << 20, 1 << 16


def opened(path: str):
    """A file, with seek, and its size."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(at), system.get_file_info(at).size


def found(path: str) -> list[str]:
    """The files of a folder, or the file."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    root = path.rstrip("/")
    inside = system.get_file_info(fs.FileSelector(at))
    return sorted(f"{root}/{x.base_name}" for x in inside if x.type == fs.FileType.File and x.size and x.base_name[0] not in "_.")


def frames(path: str) -> list[tuple[int, int]]:
    """(begin, end) of each frame of a zstd file, skippable ones left out, by headers alone."""
    file, size = opened(path)
    out, at, window, base = [], 0, b"", 0

    def look(pos: int, n: int) -> bytes:
        nonlocal window, base
        if not base <= pos <= pos + n <= base + len(window):
            file.seek(pos)
            window, base = file.read(4096), pos
        got = window[pos - base : pos - base + n]
        if len(got) < n:
            raise ValueError(f"{path} ends inside a frame")
        return got

    with file:
        while at < size:
            magic = int.from_bytes(look(at, 4), "little")
            if magic & 0xFFFFFFF0 == SKIPPABLE:
                at += 8 + int.from_bytes(look(at + 4, 4), "little")
                continue
            if magic != FRAME:
                raise ValueError(f"{path} has no frame at byte {at}")
            flags = look(at + 4, 1)[0]
            single, content = flags >> 5 & 1, CONTENT[flags >> 6]
            pos = at + 5 + (1 - single) + DICTIONARY[flags & 3] + (content or single)
            last = 0
            while not last:
                head = int.from_bytes(look(pos, 3), "little")
                last, kind, length = head & 1, head >> 1 & 3, head >> 3
                pos += 3 + (1 if kind == 1 else length)  # a run of one byte holds that byte
            pos += 4 * (flags >> 2 & 1)  # the checksum
            out.append((at, pos))
            at = pos
    return out


@dataclass
class Part(InputPartition):
    path: str
    index: int
    begin: int
    end: int
    first: bool


def records(chunks: Iterator[tuple[bytes, bool]], marker: bytes, first: bool) -> Iterator[bytes]:
    """Records of a partition: ``chunks`` are its bytes and then what follows it in the file, each with whether it is its own. The text
    before the first marker is a record only in the first partition, and only if it is not blank."""
    mark = b"\n" + marker
    now, mine, start, seek, started = b"", 0, 0, 0, first  # mine: how many bytes of ``now`` are the partition's
    for chunk, own in chunks:
        now, mine, seek, start = now[start:] + chunk, max(mine - start, 0), seek - start, 0
        mine = len(now) if own else mine
        while (at := now.find(mark, seek)) >= 0:
            if started and not (record := now[start : at + 1]).isspace():
                yield record
            if at >= mine:  # the next record begins at a line end of another partition
                return
            started, start, seek = True, at + 1, at + 1
        if not started:  # nothing before the last bytes can begin a record
            start = max(len(now) - len(mark) + 1, 0)
            if not own and start >= mine:
                return
        seek = max(len(now) - len(mark) + 1, start)
    if started and now[start:].strip():
        yield now[start:]


class ZstdRecords(DataSource):
    """Options: path, a file or folder of zstd files; marker, what a record's first line begins with, empty for lines; split, compressed
    bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "zstd_records"

    def schema(self) -> str:
        return "path string, part int, row bigint, value string"

    def reader(self, schema) -> DataSourceReader:
        return _ZstdReader(self.options["path"], self.options.get("marker", ""), int(self.options.get("split", SPLIT)))


class _ZstdReader(DataSourceReader):
    def __init__(self, path: str, marker: str, split: int):
        self.path, self.marker, self.split = path, marker.encode(), split

    def partitions(self) -> list[Part]:
        out = []
        for path in found(self.path):
            lots: list[list[int]] = []
            for begin, end in frames(path):
                if lots and end - lots[-1][0] <= self.split:
                    lots[-1][1] = end
                else:
                    lots.append([begin, end])
            out += [Part(path, k, begin, end, k == 0) for k, (begin, end) in enumerate(lots)]
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        import zstandard

        def chunks() -> Iterator[tuple[bytes, bool]]:
            file, _ = opened(part.path)
            with file:
                file.seek(part.begin)
                own = _Limited(file, part.end - part.begin)
                for source, mine in ((own, True), (file, False)):
                    with zstandard.ZstdDecompressor().stream_reader(source, read_across_frames=True, closefd=False) as raw:
                        while got := raw.read(CHUNK if mine else REST):
                            yield got, mine

        lot, size, n = [], 0, 0
        for r in records(chunks(), self.marker, part.first):
            lot.append(r.decode("utf-8", "replace"))
            size += len(r)
            if size >= CHUNK:
                yield _batch(part.path, part.index, n, lot)
                lot, size, n = [], 0, n + len(lot)
        if lot:
            yield _batch(part.path, part.index, n, lot)


class _Limited(io.RawIOBase):
    """The next ``n`` bytes of a file."""

    def __init__(self, file, n: int):
        self.file, self.left = file, n

    def readable(self) -> bool:
        return True

    def read(self, n: int = -1) -> bytes:
        got = self.file.read(min(n, self.left) if n >= 0 else self.left)
        self.left -= len(got)
        return got


def _batch(path: str, part: int, n: int, lot: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path] * len(lot)), pa.array([part] * len(lot), pa.int32()), pa.array(range(n, n + len(lot)), pa.int64()), pa.array(lot, pa.string())],
                                      ["path", "part", "row", "value"])


class ZipColumn(DataSource):
    """Options: path, a file or folder of zip files; column, of the first member whose name ends in .csv. Rows without a value go. A file
    is one task, as its member is one stream, but of any size."""

    @classmethod
    def name(cls) -> str:
        return "zip_column"

    def schema(self) -> str:
        return "path string, part int, row bigint, value string"

    def reader(self, schema) -> DataSourceReader:
        return _ZipReader(self.options["path"], self.options.get("column", "pgn"))


class _ZipReader(DataSourceReader):
    def __init__(self, path: str, column: str):
        self.path, self.column = path, column

    def partitions(self) -> list[Part]:
        return [Part(path, 0, 0, 0, True) for path in found(self.path)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        import csv

        csv.field_size_limit(1 << 30)
        file, _ = opened(part.path)
        with file, zipfile.ZipFile(file) as z:
            member = next((m for m in z.namelist() if m.lower().endswith(".csv")), None)
            if member is None:
                raise ValueError(f"{part.path} has no csv member")
            with z.open(member) as raw:
                rows = csv.DictReader(io.TextIOWrapper(raw, "utf-8", errors="replace", newline=""))
                if self.column not in (rows.fieldnames or []):
                    raise ValueError(f"{part.path} has no column {self.column}")
                lot, size, n = [], 0, 0
                for r in rows:
                    if r[self.column]:
                        lot.append(r[self.column])
                        size += len(lot[-1])
                    if size >= CHUNK:
                        yield _batch(part.path, 0, n, lot)
                        lot, size, n = [], 0, n + len(lot)
                if lot:
                    yield _batch(part.path, 0, n, lot)


def by_order(df: DataFrame, order: str) -> DataFrame:
    """Rows in ranges of ``order``, one for each file that is written, which follow each other as the files' names do. There are as many as
    shuffles have partitions, and at least as many as the input has, so that a task's share does not grow with the table."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())
    return df.repartitionByRange(n, order).sortWithinPartitions(order)


def write_zstd(df: DataFrame, path: str, value: str, rows: int = 1000, header: str = "") -> int:
    """Writes a text column as zstd files, one for each partition, with a frame for each ``rows`` rows. Files are named by partition and
    renamed when they are whole, so a task that runs again writes over its own. Each file with rows begins with ``header``, a frame of its own.
    Returns the number of frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        import zstandard
        from pyarrow import fs
        from pyspark import TaskContext

        system, at = fs.FileSystem.from_uri(path)
        system.create_dir(at)
        name, new, n = f"{at}/part-{TaskContext.get().partitionId():05}.zst", f"{at}/_{uuid.uuid4().hex}", 0
        with system.open_output_stream(new) as out:
            for b in batches:
                texts = b.column(0).to_pylist()
                if header and texts and not n:
                    out.write(zstandard.compress(header.encode()))
                    n += 1
                for lo in range(0, len(texts), rows):
                    out.write(zstandard.compress("".join(t or "" for t in texts[lo : lo + rows]).encode("utf-8", "surrogatepass")))
                    n += 1
        system.move(new, name)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return df.select(F.col(value)).mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0


def zstd(spark: SparkSession, path: str, marker: str = "", split: int = SPLIT) -> DataFrame:
    """(path, part, row, value): the records of zstd files; row counts from 0 in each part, a partition of the file."""
    spark.dataSource.register(ZstdRecords)
    return spark.read.format("zstd_records").options(path=path, marker=marker, split=split).load()


def zipped(spark: SparkSession, path: str, column: str) -> DataFrame:
    spark.dataSource.register(ZipColumn)
    return spark.read.format("zip_column").options(path=path, column=column).load()


def numbered(rows: DataFrame, across: bool = False) -> DataFrame:
    """(path, local_id, value): the records of each file counted from 1, or, if ``across``, those of all files in the order of their
    names. The small table of parts gives each its offset, and
    a row for each file the files' offsets."""
    parts = rows.groupBy("path", "part").agg(F.count("*").alias("n"))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("path", "part", "n", earlier(Window.partitionBy("path").orderBy("part")).alias("before"))
    if across:  # in one row for each file, so that no file is read once more
        of_file = offsets.groupBy("path").agg(F.sum("n").alias("n"), F.collect_list(F.struct("part", "before")).alias("parts"))
        of_part = of_file.select("path", "parts", earlier(Window.orderBy("path")).alias("files")).select("path", "files", F.inline("parts"))
        offsets = of_part.withColumn("before", F.col("before") + F.col("files"))
    offsets = offsets.select("path", "part", "before")
    return rows.join(offsets, ["path", "part"]).select("path", (F.col("before") + F.col("row") + 1).alias("local_id"), "value")


def staged_table(spark: SparkSession, source: str, target: str, schema: str, split: int = SPLIT) -> DataFrame:
    """A compressed CSV table with a header line as Parquet, which can be split anywhere: decompressed by frames, once. A target that was
    finished is read as it is; one that was not, or that is empty, is made anew. A line is a row; malformed ones are null."""
    if not (files.exists(spark, f"{target}/_SUCCESS") and any(n.endswith(".parquet") for n in files.names(spark, target))):
        lines = zstd(spark, source, split=split).where("not (part = 0 and row = 0)").select(F.rtrim("value", F.lit("\r\n")).alias("line")).where("line <> ''")
        lines.select(F.from_csv("line", schema).alias("r")).select("r.*").write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)
