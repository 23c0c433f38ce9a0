"""WARC archives of pages: a deterministic writer in shards, and a reader.

Records are sorted by page id, then by payload. A shard holds about ``SHARD_BYTES`` bytes of payload: its first record is found by exact
sums over the sorted rows, so shards do not depend on how Spark samples or splits. Within a shard files roll when the next record would take one past
``ROLL_BYTES`` compressed bytes. Each record is a gzip member of its own, made before the only exchange that moves
payloads, which therefore moves compressed bytes. Names, headers, dates and digests follow from the rows alone: the same rows give the same files, byte for byte.

A task writes files under a temporary name that no other attempt has, and returns a row for each. Only the rows of the attempts that count get into the
manifest; a second job gives those files their names, and can be run again if it is broken off; the manifest is written last. Without a manifest
an archive does not count.

Executors open files by pyarrow's file systems, so the folder is a URI that all of them reach (file, hdfs, s3, gs); the reader is Spark's own.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, shared_folder

SHARD_BYTES, ROLL_BYTES, LEVEL = 64 << 20, 16 << 20, 3
#: Shards are made larger where there would be more; their first keys pass through the driver, some 40 bytes each.
MOST_SHARDS = 1 << 16
DATE = "1970-01-01T00:00:00Z"

FOUND = T.StructType([T.StructField("page_id", T.StringType()), T.StructField("url", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.StringType()), T.StructField("payload", T.BinaryType())])
_FILES = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("turn", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("held", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("records", T.LongType()), T.StructField("sha256", T.StringType())])


def _opened(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(re.sub(r"^([A-Za-z][A-Za-z0-9+.-]*):/(?!/)", r"\1:///", uri))


def record_id(page_id: object, digest: str, copy: int = 0) -> str:
    """A URI that names the record, and from which the page's id can be read; a null id has no last part."""
    return f"<urn:page:{digest}.{copy}" + ("" if page_id is None else f":{quote(str(page_id), safe='')}") + ">"


def page_of(record: str) -> str | None:
    head, _, page = record.strip().strip("<>").removeprefix("urn:page:").partition(":")
    return unquote(page) if _ else None


def _member(headers: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers)
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + lines.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n") + packer.flush()


def _uri(url: str | None, page_id: object) -> str:
    """The page's address without blanks or control characters, which would break a header."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else record_id(page_id, "none").strip("<>")


def _headers(kind: str, page_id: object, url: str | None, digest: str, copy: int, date: str) -> list[tuple[str, str]]:
    return [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, digest, copy)), ("WARC-Date", date), ("WARC-Target-URI", _uri(url, page_id)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]


def _http(n: int) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n


def _block_digest(block: bytes) -> tuple[str, str]:
    return "WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def response(page_id: object, url: str | None, payload: bytes, digest: str, copy: int, date: str, level: int) -> bytes:
    block = _http(len(payload)) + payload
    return _member([*_headers("response", page_id, url, digest, copy, date), _block_digest(block)], block, level)


def revisit(page_id: object, url: str | None, n: int, digest: str, copy: int, first: object, date: str, level: int) -> bytes:
    """A record without payload that refers to the response of page ``first``; its block is the head of that response."""
    more = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(first, digest)), _block_digest(_http(n))]
    return _member([*_headers("revisit", page_id, url, digest, copy, date), *more], _http(n), level)


def members(content: bytes) -> Iterator[bytes]:
    """The gzip members of a file, one after the other."""
    view, at, step = memoryview(content), 0, 1 << 16
    while at < len(view):
        packer, parts = zlib.decompressobj(31), []
        while not packer.eof:
            if at >= len(view):
                raise ValueError("the archive ends within a record")
            chunk = view[at : at + step]
            parts.append(packer.decompress(chunk))
            at += len(chunk)
        at -= len(packer.unused_data)
        yield b"".join(parts)


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(headers["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError(f"{headers.get('warc-record-id')}: its length is wrong")
    return headers, rest[:n]


def _keyed(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, sha (SHA-1), extra (another hash) and bytes; payloads are equal if the last three are."""
    base = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    return base.withColumns({"sha": F.unhex(F.sha1("payload")), "extra": F.xxhash64("payload"), "bytes": F.octet_length("payload").cast("long")})


def _sorts(page_id: object, sha: bytes) -> tuple:
    """Sorts as Spark does: nulls first, texts by bytes."""
    return page_id is not None, page_id.encode() if isinstance(page_id, str) else page_id or 0, sha


def _starts(slim: DataFrame, shard_bytes: int) -> list[tuple]:
    """The first key of each shard; ``slim`` is a written table in ranges, ``part``."""
    sums = slim.groupBy("part").agg(F.sum("bytes").alias("sum"))
    before = sums.select("part", (F.sum("sum").over(W.orderBy("part")) - F.col("sum")).alias("before"))  # a row for each range
    total = sums.agg(F.sum("sum")).head()[0] or 0
    size = max(shard_bytes, total // MOST_SHARDS + 1)
    running = F.sum("bytes").over(W.partitionBy("part").orderBy("page_id", "sha").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("bytes")
    shard = F.floor((F.col("before") + running) / F.lit(size))
    found = slim.withColumn("bytes", F.col("bytes").cast("decimal(38,0)")).join(before, "part").withColumn("shard", shard).groupBy("shard").agg(F.min(F.struct("page_id", "sha")).alias("k"))
    return sorted(_sorts(r.k.page_id, bytes(r.k.sha)) for r in found.collect())


def write_archives(pages: DataFrame, path: str, least_payload: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, level: int = LEVEL, date: str = DATE) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html) under ``path``; the manifest: a row for each file.

    Of records whose payloads are equal and have ``least_payload`` bytes or more, the one with the largest page_id is a response and the others refer to it; the rest are
    responses. A null html is an empty payload, a null url is replaced by the record's name, a null page_id is the least of all. Of rows that repeat an id and a payload that is the
    response's, one is the response. Ids are whole numbers or texts. Payloads are kept whole, however long; further columns are ignored. An empty table gives an empty
    manifest. A folder that has a manifest is not written to again. All rows of one id and payload are in one shard, which is written by one task, in files of bounded size.
    """
    spark = pages.sparkSession
    if _exists(spark, f"{path}/manifest"):
        raise ValueError(f"{path} holds an archive")
    scratch = Scratch(spark)
    keyed = _keyed(pages)
    slim = keyed.select("page_id", "sha", "extra", "bytes").repartitionByRange("page_id", "sha").withColumn("part", F.spark_partition_id())
    slim = scratch.keep(slim)
    key = ["sha", "extra", "bytes"]
    groups = slim.where(F.col("bytes") >= least_payload).groupBy(*key).agg(F.max(F.struct("page_id")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    notes = slim.select("page_id", *key).distinct().join(groups, key).select(F.lit(0).alias("kind"), "page_id", *key, F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), F.col("first.page_id").alias("first"))
    rows = keyed.select(F.lit(1).alias("kind"), "page_id", *key, "url", "payload", F.lit(None).cast(pages.schema["page_id"].dataType).alias("first"))
    starts = _starts(slim, shard_bytes)

    id_type = pages.schema["page_id"].dataType
    packed = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("page_id", id_type), T.StructField("sha", T.BinaryType()), T.StructField("extra", T.LongType()), T.StructField("bytes", T.LongType()), T.StructField("url", T.StringType()), T.StructField("first", id_type), T.StructField("member", T.BinaryType())])

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids, shas, urls = (part.column(c).to_pylist() for c in ("page_id", "sha", "url"))
                shard = [max(0, bisect.bisect_right(starts, _sorts(i, s)) - 1) for i, s in zip(ids, shas, strict=True)]
                made = [None if p.as_py() is None else response(i, u, p.as_py(), base64.b32encode(s).decode(), 0, date, level) for i, s, u, p in zip(ids, shas, urls, part.column("payload"), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), part.column("kind"), part.column("page_id"), part.column("sha"), part.column("extra"), part.column("bytes"), part.column("url"), part.column("first"), pa.array(made, pa.binary())], names=packed.names)

    def store(batches):
        files, folder = _opened(path)
        attempt = f"_temporary/{uuid.uuid4().hex}"
        files.create_dir(f"{folder}/{attempt}", recursive=True)
        out = _Files(files, folder, attempt, date, level, roll_bytes)
        note, last, copy = None, None, 0
        for batch in batches:
            for shard, kind, page_id, sha, extra, n, url, first, member in zip(*(batch.column(c) for c in packed.names), strict=True):
                own = (page_id.as_py(), sha.as_py(), extra.as_py(), n.as_py())
                if kind.as_py() == 0:
                    note = (own, first.as_py())
                    continue
                copy = copy + 1 if own == last else 0
                last = own
                digest, body = base64.b32encode(own[1]).decode(), member.as_py()
                if note and note[0] == own and (note[1] != own[0] or copy):
                    body = revisit(own[0], url.as_py(), own[3], digest, copy, note[1], date, level)
                elif copy:  # a repeated row, below the least payload: its name differs in the copy's number
                    block = parsed(next(members(body)))[1]
                    body = response(own[0], url.as_py(), block[len(_http(own[3])) :], digest, copy, date, level)
                yield from out.add(shard.as_py(), body)
        yield from out.end()

    count = max(1, len(starts))
    dealt = rows.unionByName(notes).mapInArrow(pack, packed).repartition(count, "shard").sortWithinPartitions("shard", "page_id", "sha", "extra", "bytes", "kind", "url")
    stored = scratch.keep(dealt.mapInArrow(store, _FILES))

    def name(batches):
        files, folder = _opened(path)
        for batch in batches:
            for held, final, n in zip(*(batch.column(c).to_pylist() for c in ("held", "name", "bytes")), strict=True):
                if files.get_file_info(f"{folder}/{held}").type == arrow_fs.FileType.File:
                    files.move(f"{folder}/{held}", f"{folder}/{final}")
                elif files.get_file_info(f"{folder}/{final}").size != n:
                    raise OSError(f"{final} is neither held nor whole")
            yield batch

    named = stored.repartition("shard").mapInArrow(name, _FILES).drop("held")
    named.write.json(f"{path}/manifest")
    scratch.drop()
    _delete(spark, f"{path}/_temporary")
    return manifest(spark, path)


class _Files:
    """The files of a task, written one at a time."""

    def __init__(self, files, folder: str, attempt: str, date: str, level: int, roll: int) -> None:
        self.files, self.folder, self.attempt, self.date, self.level, self.roll = files, folder, attempt, date, level, roll
        self.shard, self.turn, self.stream = None, 0, None

    def add(self, shard: int, body: bytes) -> Iterator[pa.RecordBatch]:
        if shard != self.shard or self.size + len(body) > self.roll and self.records:
            yield from self.end()
            self.turn = self.turn + 1 if shard == self.shard else 0
            self.shard, self.records, self.size, self.hash = shard, 0, 0, hashlib.sha256()
            self.name = f"part-{shard:05d}-{self.turn:05d}.warc.gz"
            self.stream = self.files.open_output_stream(f"{self.folder}/{self.attempt}/{self.name}", compression=None)
            block = b"format: WARC File Format 1.1\r\nisPartOf: pages\r\n"
            self._put(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{self.name}>"), ("WARC-Date", self.date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields"), _block_digest(block)], block, self.level))
        self._put(body)
        self.records += 1

    def _put(self, body: bytes) -> None:
        self.stream.write(body)
        self.hash.update(body)
        self.size += len(body)

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.stream:
            self.stream.close()
            self.stream = None
            own = [self.shard, self.turn, self.name, f"{self.attempt}/{self.name}", self.size, self.records, self.hash.hexdigest()]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(own, kinds, strict=True)], names=_FILES.names)


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _exists(spark: SparkSession, path: str) -> bool:
    files, place = _hadoop(spark, path)
    return files.exists(place)


def _delete(spark: SparkSession, path: str) -> None:
    files, place = _hadoop(spark, path)
    files.delete(place, True)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """shard, turn, name, bytes, records, sha256 of the archive's files."""
    return spark.read.schema(T.StructType([f for f in _FILES if f.name != "held"])).json(f"{path}/manifest")


def damaged(spark: SparkSession, path: str) -> DataFrame:
    """name of the files that the manifest has and the folder has not, or with other bytes, and of those that only the folder has."""
    there = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"))
    return manifest(spark, path).join(there, "name", "full").where("not sha256 <=> found").select("name")


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null unless asked for) of every record of an archive.

    Ids come as text. A response's digest is computed from what was read and must be the header's, else this raises; a revisit has those of its headers. A
    folder without a manifest raises, one without records gives an empty table. A file is read by one task.
    """
    if not _exists(spark, f"{path}/manifest/_SUCCESS"):
        raise ValueError(f"{path} has no manifest")

    def task(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for headers, block in map(parsed, members(content.as_py())):
                    kind = headers["warc-type"]
                    if kind in ("response", "revisit"):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        n, digest = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", head)[1]), headers["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and (len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                            raise ValueError(f"{headers['warc-record-id']}: its payload is damaged")
                        refers = headers.get("warc-refers-to")
                        rows.append((page_of(headers["warc-record-id"]), headers["warc-target-uri"], n, digest, kind, page_of(refers) if refers else None, payload if payloads and kind == "response" else None))
                    if len(rows) >= 500:
                        yield _found(rows)
                        rows = []
                if rows:
                    yield _found(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path)
    return files.select("content").mapInArrow(task, FOUND)


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=FOUND.names)


_DIGITS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {5 * g + 1}, 5))::int >> {15 - 5 * k}) & 31), 1)" for g in range(8) for k in range(4))
SQL = f"""
with p as (select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as h from pages),
o as (select page_id, h, strlen(payload) as n, max(page_id) over (partition by payload) as first from p)
select page_id, n as payload_bytes, {_DIGITS} as payload_digest, if(page_id = first, 'response', 'revisit') as record_type, if(page_id = first, null, first) as refers_to from o"""


def op13_warc(spark, sf_dir):
    """A record for each row of ``pages``, as read back from the archives that were written in the shared folder."""
    from .common import table

    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))
