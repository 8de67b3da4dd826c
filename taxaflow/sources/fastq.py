"""FASTQ and FASTA scans, both in byte ranges.

FASTQ is a Python data source: a compressed file is one partition, a plain one is cut into byte ranges. A range begins at the first record
that starts in it: a line with @ whose line after next has + and whose sequence and quality have one length. A quality line may begin with
@ too, but then a sequence stands two lines on, never a +.
"""

from __future__ import annotations

import fnmatch
import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from taxaflow.functions.names import barcode_no, sample_name

ENDINGS = (".fastq", ".fq", ".fastq.gz", ".fq.gz")
RANGE_BYTES = 64 << 20
SCHEMA = "file string, read_ord long, read_id string, seq string, qual string"


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int | None):
        self.path, self.start, self.end = path, start, end


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def find_files(path: str, glob: str | None = None, recursive: bool = False) -> list[tuple[str, int]]:
    """(path, bytes) of the FASTQ files under a folder, sorted and once each; a single file is taken as it is, whatever the glob."""
    from pyarrow import fs as pafs

    fs, top = _filesystem(path)
    info = fs.get_file_info(top)
    if info.type == pafs.FileType.File:
        return [(top, info.size)]
    found = fs.get_file_info(pafs.FileSelector(top, recursive=recursive))
    good = [f for f in found if f.type == pafs.FileType.File and f.base_name.lower().endswith(ENDINGS) and (not glob or fnmatch.fnmatch(f.base_name, glob))]
    return sorted({(f.path, f.size) for f in good})


def records(lines: Iterator[bytes]) -> Iterator[tuple[bytes, bytes, bytes]]:
    """(header, sequence, quality) to the end or to a truncated record."""
    it = iter(lines)
    for head in it:
        rest = [next(it, None) for _ in range(3)]
        if None in rest:
            return
        yield head.strip(), rest[0].strip(), rest[2].strip()


def first_record(data: bytes, at: int) -> int | None:
    """The offset of the first record that starts at a line of `data` from `at` on."""
    if at:
        at = data.find(b"\n", at - 1) + 1
        if not at:
            return None
    while at < len(data):
        ends, p = [], at
        for _ in range(4):
            e = data.find(b"\n", p)
            ends.append(e if e >= 0 else len(data))
            p = ends[-1] + 1
        a, b, c, d = ends
        plus, seq, qual = data[b + 1 : c], data[a + 1 : b].strip(), data[c + 1 : d].strip()
        if data[at : at + 1] == b"@" and plus[:1] == b"+" and len(seq) == len(qual):
            return at
        at = a + 1
    return None


class FastqReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[Range]:
        size = int(self.options.get("rangebytes", RANGE_BYTES))
        out = []
        for path, n in find_files(self.options["path"], self.options.get("glob"), self.options.get("recursive", "false").lower() == "true"):
            out += [Range(path, 0, None)] if path.endswith(".gz") else [Range(path, a, min(n, a + size)) for a in range(0, n, size)]
        return out or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[tuple]:
        if not part.path:
            return
        fs = _filesystem(self.options["path"])[0]
        if part.end is None:
            with fs.open_input_stream(part.path, compression=None) as raw, gzip.open(raw) as f:
                for k, (head, seq, qual) in enumerate(records(f)):
                    yield part.path, k, head[1:].decode(errors="ignore").split(" ")[0], seq.decode(errors="ignore"), qual.decode(errors="ignore")
            return
        with fs.open_input_file(part.path) as f:
            before = max(0, part.start - 1)
            f.seek(before)
            look = 1 << 20
            data = f.read(look)
            start = first_record(data, part.start - before) if part.start else 0
            while start is None and len(data) == look:  # a record may be longer than what was looked at
                look *= 2
                f.seek(before)
                data = f.read(look)
                start = first_record(data, part.start - before)
            if start is None:
                return
            f.seek(before + start)
            at, text = before + start, io.BufferedReader(f, 1 << 20)
            while at < part.end:
                lines = [text.readline() for _ in range(4)]
                if not lines[3]:
                    return
                yield part.path, at, lines[0].strip()[1:].decode(errors="ignore").split(" ")[0], lines[1].strip().decode(errors="ignore"), lines[3].strip().decode(errors="ignore")
                at += sum(map(len, lines))


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastqReader:
        return FastqReader(dict(self.options))


def read_fastq(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = False, style: str = "stem", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """reads(file, sample, read_ord, read_id, seq, qual); read_ord rises along a file (a record's number, or its offset in a plain file)."""
    spark.dataSource.register(FastqSource)
    reader = spark.read.format("fastq").option("recursive", str(recursive).lower()).option("rangebytes", range_bytes)
    rows = (reader.option("glob", glob) if glob else reader).load(path)
    return rows.select("file", sample_name(F.col("file"), style).alias("sample"), "read_ord", "read_id", "seq", "qual")


def _first_of_file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which row is the first of its file: rows of one range of a file come together and in order."""
    last = None
    for b in batches:
        first = []
        for at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            first.append(at[1] == 0 and at != last)
            last = at
        yield pa.RecordBatch.from_arrays([pa.array(first, pa.bool_()), b.column(2)], names=["first", "value"])


def read_fasta(spark: SparkSession, path: str, iupac_to_n: bool = False) -> DataFrame:
    """(name, seq): lines joined, upper case, anything but ACGTN deleted (or other IUPAC codes made N), empty ones dropped.

    Files are read in byte ranges that end at a record: the line separator is a line's end with the next header's mark, and a record belongs
    to the range in which it begins. What stands before a file's first header is a record without name.
    """
    chunks = spark.read.text(path, lineSep="\n>").select("_metadata.file_path", "_metadata.file_block_start", "value")
    chunks = chunks.mapInArrow(_first_of_file, "first boolean, value string")
    # A file's first record still has its mark, or a first line that is no header.
    record = F.when(~F.col("first"), F.col("value")).when(F.ltrim("value").startswith(">"), F.regexp_replace("value", r"^\s*>", "")).otherwise(F.concat(F.lit("\n"), "value"))
    parts = chunks.select(F.explode(F.split(record, r"(?m)^[ \t]+>")).alias("p"))  # headers that are indented
    name = F.regexp_extract("p", r"^([^\r\n]*)", 1)
    seq = F.upper(F.substring("p", F.length(name) + 1, F.length("p")))
    seq = F.regexp_replace(F.translate(seq, "RYSWKMBDHV", "NNNNNNNNNN"), "[^ACGTN]", "") if iupac_to_n else F.regexp_replace(seq, "[^ACGTN]", "")
    return parts.select(F.trim(name).alias("name"), seq.alias("seq")).where("seq <> ''")


def samples_from_layout(files: DataFrame, max_barcode: int, path: str = "file") -> DataFrame:
    """(barcode, file): the first file of each barcode folder up to a number."""
    numbered = files.select(barcode_no(F.regexp_extract(path, r"(?i)/(barcode\d+)/", 1)).alias("no"), F.col(path).alias("file"))
    return numbered.where(F.col("no").between(1, max_barcode)).groupBy("no").agg(F.min("file").alias("file")).select(F.format_string("barcode%02d", "no").alias("barcode"), "file")
