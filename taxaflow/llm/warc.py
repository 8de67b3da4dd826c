"""WARC archives with a two-level capture index.

Archives hold one gzip member for each record, so a record can be read by its range. The index maps a capture's key, the URL with its
host reversed (com,example)/path) and the page's id, to archive, offset and length. Its lines are sorted and cut into blocks, which are
compressed one by one; a sparse directory keeps each block's first key. A lookup searches the shards, the directory of one and a block by
halving, and then reads the record's range. Files are written to the folder that driver and executors share, under names that no other
attempt of a task uses; only those of attempts that ended well are ever referred to.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import zlib
from collections import OrderedDict
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_broadcast, new_path, saved

#: Lines of an index block; the fast setting of the compressor; payloads from this size on are written once.
BLOCK_LINES, LEVEL, MIN_REVISIT_BYTES = 512, 1, 0
#: Digests that come twice up to which they are broadcast; bytes of archives that one task reads back.
MAX_BROADCAST_DIGESTS, READ_BYTES = 400_000, 32 << 20
DATE, PROFILE = "2024-01-01T00:00:00Z", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
END = b"\r\n\r\n"


def filesystem(uri: str):
    """The Arrow file system of a folder's URI, and its path there."""
    from pyarrow import fs

    uri = re.sub(r"^file:/(?!/)", "file:///", uri).replace("s3a://", "s3://", 1)
    return fs.FileSystem.from_uri(uri)


def surt(url: Column) -> Column:
    """The URL with its host reversed; without scheme, user, port, fragment and leading www; white space is %20."""
    m = lambda k: F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:[Ww]{3}\d*\.)?([^/?#:]*)(?::\d*)?([^#]*)", k)
    host = F.array_join(F.reverse(F.split(F.lower(m(1)), r"\.")), ",")
    whole = F.when(m(1) != "", F.concat(host, F.lit(")"), F.when(m(2).startswith("/"), m(2)).otherwise(F.concat(F.lit("/"), m(2))))).otherwise(url)
    return F.coalesce(F.regexp_replace(whole, r"\s", "%20"), F.lit(""))


def capture_key(url: Column, page_id: Column) -> Column:
    return F.concat(surt(url), F.lit(" "), F.coalesce(page_id.cast("string"), F.lit("-")))


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1, from its hex digits: five of them are four digits to the base of 32."""
    hexed = F.sha1(data)
    digits = F.concat(*[F.lpad(F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES, max_broadcast: int = MAX_BROADCAST_DIGESTS) -> DataFrame:
    """(key, page_id, url, payload, digest, first_id, first_key): first_id is null for a response, else the page that a revisit repeats.

    The smallest page_id of each payload is found by an aggregate over digests that combines before it shuffles. Only digests that come
    twice go back to the pages; up to `max_broadcast` of them are broadcast, so payloads stay where they are.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.select("page_id", "url", "payload", base32_sha1(F.col("payload").cast("binary")).alias("digest"), capture_key(F.col("url"), F.col("page_id")).alias("key"))
    large = rows.where(F.octet_length("payload") >= min_revisit_bytes)
    firsts = large.groupBy(F.col("digest").alias("of")).agg(F.count("*").alias("n"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "key"))).alias("f"))
    firsts = saved(firsts.where("n > 1 and f is not null").select("of", F.col("f.page_id").alias("first_id"), F.col("f.key").alias("first_key")), "firsts")
    firsts = bounded_broadcast(firsts, max_broadcast)
    joined = rows.join(firsts, (F.col("digest") == F.col("of")) & (F.octet_length("payload") >= min_revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id")), "left")
    return joined.select("key", "page_id", "url", "payload", "digest", "first_id", "first_key")


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'-' if page_id is None else page_id}>"


def spelt(page_id: int | None, url: str | None, payload: bytes, digest: str, first_id: int | None, first_key: str | None) -> bytes:
    """One record, not compressed."""
    revisit = first_id is not None
    head = HTTP % len(payload)
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + re.sub(r"\s", "%20", url or ""),
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: {_name(first_id)}", f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Key: {first_key}"]
    return "\r\n".join(lines).encode() + END + block + END


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the payload: what follows the HTTP head."""
    at = record.index(END)
    headers = dict(x.split(": ", 1) for x in record[:at].decode().split("\r\n")[1:] if ": " in x)
    headers = {k.lower(): v for k, v in headers.items()}
    block = record[at + 4 : at + 4 + int(headers["content-length"])]
    return headers, block[block.index(END) + 4 :]


def _attempt() -> str:
    from pyspark import TaskContext

    t = TaskContext.get()
    return f"{t.partitionId():06d}-{t.taskAttemptId()}"


def _write_archives(folder: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = filesystem(folder)
        fs.create_dir(top, recursive=True)
        name, at = f"{_attempt()}.warc.gz", 0
        with fs.open_output_stream(f"{top}/{name}", compression=None) as f:
            for b in batches:
                offsets, lengths = [], []
                for k in range(b.num_rows):
                    key, page_id, url, payload, digest, first_id, first_key = (b.column(c)[k].as_py() for c in range(7))
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    data = packer.compress(spelt(page_id, url, payload.encode("utf-8", "surrogatepass"), digest, first_id, first_key)) + packer.flush()
                    f.write(data)
                    offsets.append(at)
                    lengths.append(len(data))
                    at += len(data)
                cols = [b.column(0), pa.array([name] * b.num_rows, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "archive", "offset", "length"])

    return run


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = MIN_REVISIT_BYTES, level: int = LEVEL) -> DataFrame:
    """Writes one archive for each task; the captures (key, archive, offset, length) are saved, so later steps don't write again."""
    rows = records(pages, min_revisit_bytes)
    return saved(rows.mapInArrow(_write_archives(folder, level), "key string, archive string, offset long, length long"), "captures")


def _write_index(folder: str, block_lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = filesystem(folder)
        fs.create_dir(top, recursive=True)
        name, at = _attempt(), 0
        first = last = b""
        directory: list[bytes] = []
        held: list[tuple[bytes, bytes]] = []

        def block(f) -> None:
            nonlocal at, first
            data = zlib.compress(b"\n".join(line for _, line in held), 6)
            f.write(data)
            directory.append(b"%b\t%d\t%d" % (held[0][0], at, len(data)))
            first = first or held[0][0]
            at += len(data)
            held.clear()

        with fs.open_output_stream(f"{top}/{name}.cdx") as f:
            for b in batches:
                for key, archive, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    last = key.encode()
                    held.append((last, b"%b\t%b\t%d\t%d" % (last, archive.encode(), offset, length)))
                    if len(held) >= block_lines:
                        block(f)
            if held:
                block(f)
        if directory:
            with fs.open_output_stream(f"{top}/{name}.dir") as f:
                f.write(b"\n".join(directory))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first], pa.binary()), pa.array([last], pa.binary())], names=["shard", "first", "last"])

    return run


def _write_top(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = filesystem(folder)
        fs.create_dir(top, recursive=True)
        name, n = f"{_attempt()}.top", 0
        with fs.open_output_stream(f"{top}/{name}") as f:
            for b in batches:
                for shard, first, last in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    f.write(b"%b\t%b\t%b\n" % (first, last, shard.encode()))
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["top", "shards"])

    return run


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> str:
    """Sorts the captures into shards of compressed blocks, and the first and last keys of the shards, a line for each task, into a file.

    Gives that file's name: readers search it before a shard's own directory.
    """
    rows = captures.repartitionByRange("key", "archive", "offset").sortWithinPartitions("key", "archive", "offset").select("key", "archive", "offset", "length")
    shards = saved(rows.mapInArrow(_write_index(folder, block_lines), "shard string, first binary, last binary"), "shards")
    tops = shards.coalesce(1).sortWithinPartitions("first", "last").mapInArrow(_write_top(folder), "top string, shards long").collect()
    return max(tops, key=lambda r: r["shards"])["top"] if tops else ""


class Reader:
    """Looks captures up. Keeps the shards' bounds, a few directories, blocks and payload sizes, never a whole index."""

    def __init__(self, archives: str, index: str, top: str, keep: int = 8):
        (self.fs, self.archives), (self.index_fs, self.index) = filesystem(archives), filesystem(index)
        lines = []
        if top:
            with self.index_fs.open_input_file(f"{self.index}/{top}") as f:
                lines = [x.split(b"\t") for x in f.read().splitlines()]
        self.shards = [(shard.decode(), first, last) for first, last, shard in lines]
        self.firsts = [s[1] for s in self.shards]
        self._directories: OrderedDict[str, tuple] = OrderedDict()
        self._blocks: OrderedDict[tuple[str, int], tuple] = OrderedDict()
        self._files: OrderedDict[str, object] = OrderedDict()
        self._payloads: OrderedDict[str, tuple[int, str]] = OrderedDict()
        self.keep = keep

    def _kept(self, cache: OrderedDict, key, make: Callable, keep: int):
        if key in cache:
            cache.move_to_end(key)
        else:
            cache[key] = make()
            while len(cache) > keep:
                old = cache.popitem(last=False)[1]
                if hasattr(old, "close"):
                    old.close()
        return cache[key]

    def _directory(self, shard: str) -> tuple[list[bytes], list[tuple[int, int]]]:
        def make():
            with self.index_fs.open_input_file(f"{self.index}/{shard}.dir") as f:
                rows = [x.rsplit(b"\t", 2) for x in f.read().split(b"\n")]
            return [x[0] for x in rows], [(int(x[1]), int(x[2])) for x in rows]

        return self._kept(self._directories, shard, make, 4)

    def _block(self, shard: str, k: int) -> tuple[list[bytes], list[bytes]]:
        def make():
            at, size = self._directory(shard)[1][k]
            lines = zlib.decompress(self._range(self.index_fs, f"{self.index}/{shard}.cdx", at, size)).split(b"\n")
            return [x.split(b"\t", 1)[0] for x in lines], lines

        return self._kept(self._blocks, (shard, k), make, self.keep)

    def _range(self, fs, path: str, at: int, size: int) -> bytes:
        f = self._kept(self._files, path, lambda: fs.open_input_file(path), 32)
        return f.read_at(size, at)

    def captures(self, key: bytes) -> Iterator[tuple[str, int, int]]:
        """(archive, offset, length) of each capture of `key`."""
        s = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while s < len(self.shards) and self.shards[s][1] <= key:
            shard, _, last = self.shards[s]
            if last >= key:
                firsts = self._directory(shard)[0]
                k = max(0, bisect.bisect_left(firsts, key) - 1)
                while k < len(firsts) and firsts[k] <= key:
                    keys, lines = self._block(shard, k)
                    i = bisect.bisect_left(keys, key)
                    while i < len(keys) and keys[i] == key:
                        archive, at, size = lines[i].split(b"\t")[1:]
                        yield archive.decode(), int(at), int(size)
                        i += 1
                    k += 1
            s += 1

    def record(self, archive: str, at: int, size: int) -> tuple[dict[str, str], bytes]:
        return parsed(zlib.decompress(self._range(self.fs, f"{self.archives}/{archive}", at, size), 31))

    def payload(self, key: str, digest: str) -> tuple[int, str]:
        """Bytes and digest, counted anew, of the payload that a response of `key` holds under `digest`."""

        def make():
            for c in self.captures(key.encode()):
                headers, payload = self.record(*c)
                if headers["warc-type"] == "response" and headers["warc-payload-digest"] == digest:
                    return len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
            raise LookupError(f"no response for {key}")

        return self._kept(self._payloads, key + digest, make, 256)


def _page(name: str) -> int | None:
    value = name.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "-" else int(value)


def _read(archives: str, index: str, top: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = Reader(archives, index, top)
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
    for b in batches:
        rows = []
        for key in b.column(0).to_pylist():
            for c in reader.captures(key.encode()):
                headers, payload = reader.record(*c)
                if headers["warc-type"] == "revisit":
                    size, digest = reader.payload(headers["warc-refers-to-key"], headers["warc-payload-digest"])
                    refers = _page(headers["warc-refers-to"])
                else:
                    size, digest, refers = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), None
                if digest != headers["warc-payload-digest"].removeprefix("sha1:"):
                    raise ValueError(f"the payload of {headers['warc-record-id']} isn't what was written")
                rows.append((_page(headers["warc-record-id"]), size, digest, headers["warc-type"], refers))
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def lookup(keys: DataFrame, archives: str, index: str, top: str, parts: int | None = None) -> DataFrame:
    """The records of each different key of `keys(key)`, by the index, in `parts` tasks; keys that it doesn't have give no rows."""
    asked = keys.select("key").distinct()
    asked = asked.repartitionByRange(parts, "key") if parts else asked.repartitionByRange("key")
    return asked.sortWithinPartitions("key").mapInArrow(partial(_read, archives, index, top), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(spark: SparkSession, pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes all pages, indexes them, and reads every capture back through the index: a row for each row of `pages`.

    A null html is an empty payload, and empty payloads revisit each other like any. Rows that repeat a page_id with the same payload are
    responses all, if it's the smallest. Pages without id revisit the smallest id with their payload, or are responses if there is none.
    A null url is an empty one. An empty table gives no rows. Pages of any length are one record each. Extra columns are ignored, whatever
    their names.
    """
    archives, index = new_path(spark, "warc"), new_path(spark, "cdx")
    captures = write_archives(pages, archives, min_revisit_bytes)
    top = write_index(captures, index)
    # Adaptive execution would see the keys' size; what a task reads are the archives.
    size = captures.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n"), F.count("*").alias("rows")).first()
    parts = max(1, min(size["rows"], max(spark.sparkContext.defaultParallelism, -(-size["n"] // READ_BYTES))))
    return lookup(captures, archives, index, top, parts)
