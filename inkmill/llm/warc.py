"""WARC archives: a deterministic sharded writer, and a reader that checks what it reads.

Records are dealt out by ranges of their id and sorted inside them. The cuts between ranges come from byte counts
of bins of equal width, so that the same table gives the same files. A shard's files roll when they pass
a compressed size. Each is written under a temporary name of its own and renamed when it is complete; the shard's
manifest, which lists its files with sizes and digests, is written last, and readers see only files
that a manifest lists. A task that is run again writes the same bytes under the same names.

Of records with equal payloads of at least ``min_revisit`` bytes the one with the largest id is a response, the
others are revisits of it without a payload. A null payload is empty, a null id sorts first and loses against
any other. Rows that repeat id and payload are all of one kind. Null addresses are left out of the headers. An id that
a third of all rows share would make one large shard of several files; its task holds a single record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.llm.common import fresh_path, lookup, text_or_empty, written

FILE_BYTES = 256 << 20  # compressed
SHARD_BYTES = 1 << 30  # of payload
DATE = "2024-01-01T00:00:00Z"
_BINS = 4096
_NULL = -(1 << 63)
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
# Fixed value: the profile of a revisit with an identical payload.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FILES = "shard int, name string, bytes long, records long, sha256 string"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:inkmill:{'none' if page_id is None else page_id}:{digest}>"


def _page_of(record_id: str) -> int | None:
    number = record_id.split(":")[2]
    return None if number == "none" else int(number)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A record with headers made anew."""
    digest = sha1_base32(payload)
    block = _HTTP % len(payload) + (b"" if revisit else payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=_URL_SAFE)}")
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


_URL_SAFE = "".join(chr(c) for c in range(0x21, 0x7F))


# ---- ranges -------------------------------------------------------------------------------------


def range_cuts(sizes: DataFrame, shards: int) -> np.ndarray:
    """Ids at which ranges of about equal weight begin, from rows (_id, _weight); the same on every run.

    Bins of equal width are weighed; those heavier than a shard are cut again, until they hold one id.
    """
    low, high, total = sizes.agg(F.min("_id"), F.max("_id"), F.sum("_weight")).first()
    if low is None or shards < 2 or low == high:
        return np.zeros(0, dtype=np.int64)

    def even(begin: int, end: int, parts: int) -> list[int]:
        parts = min(parts, end - begin)
        return [begin + (end - begin) * i // parts for i in range(parts)]

    edges = even(low, high + 1, _BINS)
    weights: dict[int, int] = {}
    for _ in range(6):
        cuts = np.array(edges, dtype=np.int64)

        @F.pandas_udf("long")
        def bin_of(ids, cuts=cuts):
            import pandas as pd

            return pd.Series(cuts[np.searchsorted(cuts, ids.to_numpy(), side="right") - 1])

        rows = sizes.filter("_id IS NOT NULL").groupBy(bin_of("_id").alias("_bin")).agg(F.sum("_weight"))
        weights = {r[0]: r[1] for r in rows.collect()}
        ends = dict(zip(edges, [*edges[1:], high + 1], strict=True))
        heavy = [b for b, w in weights.items() if w > total / shards and ends[b] - b > 1]
        if not heavy:
            break
        edges = sorted({*edges, *(e for b in heavy for e in even(b, ends[b], 64))})
    found, held, goal = [], 0, total / shards
    for edge in edges:
        weight = weights.get(edge, 0)
        if held and held + weight / 2 > goal * (len(found) + 1):
            found.append(edge)
        held += weight
    return np.array(sorted(set(found)), dtype=np.int64)


# ---- writer -------------------------------------------------------------------------------------


class _Roller:
    """The files of one shard."""

    def __init__(self, folder: str, shard: int, most: int, level: int) -> None:
        self.files: list[dict] = []
        self._system, self._root = fs.FileSystem.from_uri(folder)
        self._shard, self._most, self._level = shard, most, level
        self._out = None

    def _open(self) -> None:
        import uuid

        self._name = f"shard-{self._shard:06d}-{len(self.files):05d}.warc.gz"
        self._temporary = f"{self._root}/tmp-{uuid.uuid4().hex}-{self._name}"
        self._out = self._system.open_output_stream(self._temporary, compression=None)
        self._bytes, self._records, self._sha = 0, 0, hashlib.sha256()
        info = f"software: inkmill\r\nformat: WARC File Format 1.1\r\nisPartOf: shard {self._shard}\r\n".encode()
        head = (
            f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:inkmill:info:{self._name}>\r\nWARC-Date: {DATE}\r\n"
            f"WARC-Filename: {self._name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
        )
        self._put(head.encode() + info + b"\r\n\r\n")

    def _put(self, data: bytes) -> None:
        packer = zlib.compressobj(self._level, zlib.DEFLATED, 31)
        for piece in (packer.compress(data), packer.flush()):
            self._out.write(piece)
            self._sha.update(piece)
            self._bytes += len(piece)

    def add(self, data: bytes) -> None:
        if self._out is None:
            self._open()
        self._put(data)
        self._records += 1
        if self._bytes >= self._most:
            self._close()

    def _close(self) -> None:
        self._out.close()
        self._out = None
        self._system.move(self._temporary, f"{self._root}/{self._name}")
        self.files.append(
            {"shard": self._shard, "name": self._name, "bytes": self._bytes, "records": self._records,
             "sha256": self._sha.hexdigest()}
        )

    def finish(self) -> list[dict]:
        """Close the last file, then commit the shard by its manifest."""
        import uuid

        if self._out is not None:
            self._close()
        name = f"{self._root}/manifests/shard-{self._shard:06d}.json"
        temporary = f"{self._root}/tmp-{uuid.uuid4().hex}.json"
        with self._system.open_output_stream(temporary) as out:
            out.write("".join(json.dumps(f) + "\n" for f in self.files).encode())
        self._system.move(temporary, name)
        return self.files


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_revisit: int = 0,
    file_bytes: int = FILE_BYTES,
    level: int = 4,
) -> DataFrame:
    """Write every row as a record below ``folder``, a URI that all executors reach; the table of files."""
    spark = pages.sparkSession
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("_id"),
        F.col(f"`{url_col}`").cast("string").alias("_url"),
        text_or_empty(f"`{payload_col}`").cast("binary").alias("_payload"),
    )
    sizes = written(
        rows.select(
            "_id", F.octet_length("_payload").cast("long").alias("_weight"), F.sha2("_payload", 256).alias("_key")
        ),
        "warc-sizes",
    )
    large = sizes.filter(F.col("_weight") >= min_revisit)
    latest = large.groupBy("_key").agg(F.max("_id").alias("_refers"))
    revisits = (
        lookup(large.select("_id", "_key"), latest, ["_key"], "inner")
        .filter("_refers IS NOT NULL AND NOT (_id <=> _refers)")
        .distinct()
    )
    total = sizes.agg(F.sum("_weight")).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // SHARD_BYTES + 1)
    cuts = range_cuts(sizes, shards)
    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(f"{root}/manifests", recursive=True)

    @F.pandas_udf("int")
    def shard_of(ids):
        import pandas as pd

        return pd.Series(np.searchsorted(cuts, ids.to_numpy(), side="right").astype(np.int32))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, files, asked = None, [], {}
        page = None
        for batch in batches:
            shard, ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            refers, urls = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for i in range(batch.num_rows):
                if roller is None or roller._shard != shard[i]:
                    files += roller.finish() if roller else []
                    roller = _Roller(folder, shard[i], file_bytes, level)
                if ids[i] != page:
                    page, asked = ids[i], {}
                if refers[i] is not None:  # comes before the rows it is about
                    asked[keys[i]] = refers[i]
                    continue
                own = None if ids[i] == _NULL else ids[i]
                to = asked.get(keys[i])
                roller.add(record(own, urls[i], batch.column(5)[i].as_py(), to, to is not None))
        if roller:
            files += roller.finish()
        yield pa.RecordBatch.from_pylist(files, schema=_FILES)

    keyed = rows.select(
        F.coalesce("_id", F.lit(_NULL)).alias("_id"), F.sha2("_payload", 256).alias("_key"),
        F.lit(None).cast("long").alias("_refers"), "_url", "_payload",
    )
    notes = revisits.select(
        F.coalesce("_id", F.lit(_NULL)).alias("_id"), "_key", "_refers",
        F.lit(None).cast("string").alias("_url"), F.lit(None).cast("binary").alias("_payload"),
    )
    dealt = (
        keyed.unionByName(notes)
        .withColumn("_shard", shard_of("_id"))
        .repartitionById(len(cuts) + 1, F.col("_shard"))
        .sortWithinPartitions("_shard", "_id", F.col("_refers").isNull(), "_key", "_url")
    )
    ordered = dealt.select("_shard", "_id", "_key", "_refers", "_url", "_payload")
    return written(ordered.mapInArrow(write, FILES), "warc-files")


_FILES = pa.schema(
    [("shard", pa.int32()), ("name", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()), ("sha256", pa.string())]
)


# ---- reader -------------------------------------------------------------------------------------

RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long"


def members(stream, piece: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    unpacker, held, data = zlib.decompressobj(31), [], b""
    while data or (data := stream.read(piece)):
        held.append(unpacker.decompress(data))
        data = unpacker.unused_data
        if unpacker.eof:
            yield b"".join(held)
            unpacker, held = zlib.decompressobj(31), []
    if held and any(held):
        raise ValueError("an archive ends inside a record")


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def read_archives(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """Records of all files that the manifests list; digests are taken anew and have to agree."""
    listed = spark.read.schema(FILES).json(f"{folder}/manifests")
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    schema = RECORDS + ", payload binary" * payloads

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with system.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for data in members(stream):
                        headers, block = parsed(data)
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        if headers["WARC-Block-Digest"] != f"sha1:{sha1_base32(block)}":
                            raise ValueError(f"{name}: a block does not fit its digest")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        response = headers["WARC-Type"] == "response"
                        if response and sha1_base32(payload) != digest:
                            raise ValueError(f"{name}: a payload does not fit its digest")
                        to = headers.get("WARC-Refers-To")
                        rows.append(
                            (
                                _page_of(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), headers["WARC-Type"],
                                None if to is None else _page_of(to), digest, int(http.rpartition(b": ")[2]),
                                payload if response else None,
                            )
                        )
                        held += len(payload)
                        if held > 8 << 20 or len(rows) >= 5000:
                            yield _batch(rows, payloads)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, payloads)

    return listed.select("name").repartition(count).mapInArrow(read, schema)


def _batch(rows: list[tuple], payloads: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    width = 7 if payloads else 6
    return pa.RecordBatch.from_arrays(columns[:width], names=names[:width])


def archive_folder(spark: SparkSession) -> str:
    """A new folder below the shared one, as a URI."""
    path = fresh_path(spark, "warc")
    return path if "://" in path else ("file://" + path.removeprefix("file:"))
