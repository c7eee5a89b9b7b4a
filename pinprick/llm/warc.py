"""WARC archives as a chunked record table.

Reading streams each archive and gives rows of (record, chunk number) with at most
``chunk_bytes`` of payload each; every chunk carries the SHA-1 and the byte count of the
payload up to its end, so the last chunk's digest is the whole payload's and no record
is ever held in one piece. Writing goes the same way: payloads become rows of (record, chunk number), which stream into one
gzip member per record while their SHA-1 is carried along and held against the stated one.

Archives are written straight to the shared folder under names that hold the task
attempt; the manifest, a Spark table, lists only the files of attempts that succeeded,
and readers go by the manifest. A lost executor leaves at most unlisted files.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import n_partitions, new_path, stored, tuned

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
MANIFEST = "file string, records long, bytes long"
CHUNKS = "file string, record long, chunk int, warc_type string, record_id string, target_uri string, refers_to string, stated_digest string, stated_bytes long, bytes_so_far long, sha1_so_far string, is_last boolean, data binary"


def plan_records(df: DataFrame, id_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """Add ``_type``, ``_refers``, ``_sha1`` and ``_bytes`` to (``_id``, ``_uri``, ``_payload``).

    Payloads are equal if their length and SHA-256 are. Which rows are revisits is found on ids and digests alone; payloads
    meet only the rows that say so, by digest and id, so that a group of any size is dealt over tasks, and without
    a shuffle where these are few.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).cast("binary")
    uri = F.col("`url`").cast("string") if "url" in df.columns else F.lit(None).cast("string")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("_id"), uri.alias("_uri"), payload.alias("_payload"))
    rows = rows.withColumn("_bytes", F.octet_length("_payload").cast("long")).withColumn("_sha1", F.sha1("_payload"))
    # small payloads are never compared: they get keys of their own and spread evenly
    rows = rows.withColumn("_same", F.when(F.col("_bytes") >= min_bytes, F.sha2("_payload", 256)))
    group = rows.where("_same is not null").groupBy("_same", "_bytes").agg(F.max("_id").alias("_top"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    again = rows.where("_same is not null").select("_id", "_same", "_bytes").distinct().join(group, ["_same", "_bytes"]).where(~F.col("_id").eqNullSafe(F.col("_top")) & F.col("_top").isNotNull())
    again = again.select(F.col("_id").alias("_i"), F.col("_same").alias("_s"), F.col("_bytes").alias("_b"), "_top")
    large = rows.where("_same is not null").join(again, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_same") == F.col("_s")) & (F.col("_bytes") == F.col("_b")), "left").drop("_i", "_s", "_b")
    small = rows.where("_same is null").withColumn("_top", F.lit(None).cast("long"))
    again = F.col("_top").isNotNull()
    return large.unionByName(small).select("_id", "_uri", "_payload", "_bytes", "_sha1", F.when(again, "revisit").otherwise("response").alias("_type"), F.col("_top").alias("_refers"))


def chunk_rows(records: DataFrame, chunk_bytes: int) -> DataFrame:
    """Planned records as rows of (record, ``_chunk``, ``_last``, ``_data``), in order and with at most ``chunk_bytes`` each; a record
    without payload, or a revisit, is one row without data."""
    n = F.when(F.col("_type") == "response", F.ceil(F.col("_bytes") / chunk_bytes)).otherwise(0).cast("int")
    rows = records.withColumn("_n", F.greatest(n, F.lit(1))).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    data = F.when(F.col("_type") == "response", F.substring(F.col("_payload"), F.col("_chunk") * chunk_bytes + 1, F.lit(chunk_bytes))).otherwise(F.lit(b""))
    return rows.select("_id", "_uri", "_bytes", "_sha1", "_type", "_refers", "_chunk", (F.col("_chunk") == F.col("_n") - 1).alias("_last"), data.alias("_data"))


def _name(record_id: int | None) -> str:
    return "null" if record_id is None else str(record_id)


def write_warc(df: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", *, min_bytes: int = 1000, file_bytes: int = 64 << 20, chunk_bytes: int = 1 << 16, level: int = 2) -> DataFrame:
    """Write one record per row below ``path``; returns the stored manifest of the files.

    Of records with equal payloads of at least ``min_bytes`` the one with the largest id
    is a response and the others are revisits of it, without a payload; smaller ones are
    all responses. Null payloads are empty; rows with a null id are named ``null``; a group in
    which only null ids occur is all responses; repeated rows of the largest id are all
    responses. An empty table gives an empty manifest. A column ``url`` becomes the target URI.
    """
    spark = tuned(df.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(path)
        files.create_dir(root, recursive=True)
        part, serial, out, done = TaskContext.get().partitionId(), 0, None, []
        name, records, size, z, so_far = "", 0, 0, None, None

        def end() -> None:
            out.close()
            done.append((name, records, size))

        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

        def put(x: bytes) -> None:
            nonlocal size
            if x:
                out.write(x)
                size += len(x)

        for b in batches:
            for rid, uri, n, sha1, kind, refers, chunk, last, data in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    name, records, size = f"part-{part:05d}-{serial:04d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                    serial += 1
                if chunk == 0:
                    z, so_far = zlib.compressobj(level, wbits=31), hashlib.sha1()
                    head = [
                        b"WARC/1.1", b"WARC-Type: " + kind.encode(), f"WARC-Record-ID: <urn:record:{_name(rid)}>".encode(), f"WARC-Date: {DATE}".encode(), b"Content-Type: application/http; msgtype=response",
                        f"WARC-Payload-Digest: sha1:{sha1}".encode(), f"X-Payload-Length: {n}".encode(), f"Content-Length: {len(http) + (n if kind == 'response' else 0)}".encode(),
                    ]
                    if uri is not None:
                        head.append(b"WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A").encode())
                    if kind == "revisit":
                        head += [f"WARC-Refers-To: <urn:record:{_name(refers)}>".encode(), f"WARC-Profile: {PROFILE}".encode()]
                    put(z.compress(b"\r\n".join(head) + b"\r\n\r\n" + http))
                so_far.update(data)
                put(z.compress(data))
                if last:
                    if kind == "response" and so_far.hexdigest() != sha1:
                        raise ValueError("a payload's chunks don't add up to it")
                    put(z.compress(b"\r\n\r\n"))
                    put(z.flush())
                    records += 1
                    if size >= file_bytes:
                        end()
                        out = None
        if out is not None:
            end()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["file", "records", "bytes"])

    return stored(chunk_rows(plan_records(df, id_col, payload_col, min_bytes), chunk_bytes).mapInArrow(write, MANIFEST), "warc-manifest")


def _records(stream, chunk_bytes: int) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
    """Headers and payload chunks of each record; the chunks must be used up before the next."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            key, _, value = line.partition(b":")
            head[key.decode().lower()] = value.strip().decode()
        left = int(head["content-length"])
        if head.get("content-type", "").startswith("application/http"):
            while left > 0:
                line = stream.readline(left)
                left -= len(line)
                if line in (b"\r\n", b"\n", b""):
                    break

        def chunks(left: int = left) -> Iterator[bytes]:
            while left:
                x = stream.read(min(left, chunk_bytes))
                if not x:
                    raise EOFError("a WARC record is cut short")
                left -= len(x)
                yield x

        yield head, chunks()


def read_warc(manifest: DataFrame, path: str, *, chunk_bytes: int = 1 << 16, with_data: bool = True) -> DataFrame:
    """The chunk table of the archives that ``manifest`` lists below ``path``.

    A record without payload has one chunk, of no bytes. ``with_data=False`` leaves the
    payload bytes out of the rows; digests and counts are still made from them. One task reads
    a file as a stream, so files are written small enough to be dealt out.
    """
    spark = tuned(manifest.sparkSession)
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    types = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(path)
        rows, held = [], 0

        def pack() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for b in batches:
            for file in b.column(0).to_pylist():
                with files.open_input_stream(f"{root}/{file}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for k, (head, chunks) in enumerate(_records(stream, chunk_bytes)):
                        sha, total, number, now = hashlib.sha1(), 0, 0, next(chunks, b"")
                        fixed = (head.get("warc-type"), head.get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-refers-to"), head.get("warc-payload-digest"), int(head["x-payload-length"]) if "x-payload-length" in head else None)
                        while now is not None:
                            sha.update(now)
                            total += len(now)
                            after = next(chunks, None)
                            rows.append((file, k, number, *fixed, total, sha.hexdigest(), after is None, now if with_data else None))
                            held += len(now) * with_data + 300
                            number, now = number + 1, after
                            if held > 4 << 20:
                                yield pack()
                                rows, held = [], 0
        if rows:
            yield pack()

    return manifest.select("file").repartition(n_partitions(spark), "file").mapInArrow(read, CHUNKS)


def record_number(column: Column) -> Column:
    """The id within ``<urn:record:ID>``; null where it is not a number."""
    return F.regexp_extract(column, r"<urn:record:(-?\d+)>", 1).try_cast("long")


def record_digests(chunks: DataFrame) -> DataFrame:
    """One row per record, from its last chunk: payload bytes and digest as read for
    responses, as stated for revisits (their payload stands in the record they refer to)."""
    revisit = F.col("warc_type") == "revisit"
    return chunks.where("is_last").select(
        record_number(F.col("record_id")).alias("page_id"), F.when(revisit, F.col("stated_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("stated_digest", "^sha1:", "")).otherwise(F.col("sha1_so_far")).alias("payload_digest"), F.col("warc_type").alias("record_type"), record_number(F.col("refers_to")).alias("refers_to"),
    )


def warc_round_trip(df: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """Write ``df`` as WARC below the shared folder and read every record's digest back."""
    path = new_path(df.sparkSession, "warc")
    return record_digests(read_warc(write_warc(df, path, id_col, payload_col), path, with_data=False))


def payloads(chunks: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Payload text of each response, its chunks put together in order (whole records in memory)."""
    parts = F.array_sort(F.collect_list(F.struct("chunk", "data")))
    return chunks.where("warc_type = 'response'").groupBy("file", "record", "record_id").agg(F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["data"])).alias("payload"))
