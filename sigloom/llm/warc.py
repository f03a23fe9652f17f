"""WARC archives: a deterministic sharded writer, and the reader of its files.

The records are range-sorted by page id, so each task holds a run of ids. The bounds of the ranges are chosen from counts of all
ids, not from a sample, so they depend on the pages and the number of shards alone. A task writes gzip members
(one per record) and rolls to a new file when the compressed size reaches ``ROLL_BYTES``. Headers
and digests are made anew from the payload; nothing depends on the clock, on the task or on how the input is partitioned, so a rerun writes the
same bytes. Files are written under temporary names that carry the attempt; the names and sizes that Spark
commits form the manifest, a second job renames exactly those (and may be repeated), and the
manifest file, written last, makes the archive valid: without it the archive isn't read. What a lost or repeated attempt leaves is never renamed.

Payloads that occur more than once: the record of the largest page id is the response, the others are
revisits that refer to it and hold its headers only. Which is which comes from (page id, digest)
rows alone; the page ids that are revisits join their pages within the one range shuffle, so a payload is
shuffled once and no group of copies meets in one task.

A null payload counts as empty, a null url as no target. A null page id sorts first and is a revisit of any
equal payload with an id. Of rows equal in id and payload one is the response (or all are revisits of a
larger id) and the rest revisit it. An id that many rows share is split over ranges by its payloads' digests. Line breaks in a url are percent-encoded. No rows: a manifest of no files.
"""

from __future__ import annotations

import base64
import hashlib
import json
import posixpath
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

ROLL_BYTES = 64 << 20
#: Bins into which a range of ids is counted at once.
BINS = 4_096
#: A bin is too full beyond this part of a shard's share, or a smaller one where shards are few; and finer bins per share of such a one.
EVEN, FINER = 8, 32
#: Every record's date: part of the input to make the output repeat, so a parameter and not the clock.
DATE = "2024-01-01T00:00:00Z"
#: Fixed value: the profile that the standard gives for revisits of an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Stands for a null id among the bounds.
_NULL = -(1 << 63)
_MANIFEST = "shard long, temporary string, name string, n_records long, n_bytes long, sha256 string"
_FILE_FIELDS = ["shard", "temporary", "name", "n_records", "n_bytes", "sha256"]


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{payload_digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One record, headers and block. A revisit's block is the response's header without its body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_uri(page_id, payload_digest)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_uri(refers_to, payload_digest)}"]
        if refers_to is not None:
            lines.append(f"X-Refers-To-Page-ID: {refers_to}")
    lines += [f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without a time stamp."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Roller:
    """Writes a shard's members to numbered temporary files of one task attempt; ``done`` gets the closed ones."""

    def __init__(self, path: str, shard: int, roll_bytes: int, done: list[tuple]):
        self.files, self.root = pfs.FileSystem.from_uri(path)
        self.shard, self.roll_bytes, self.attempt = shard, roll_bytes, uuid.uuid4().hex[:12]
        self.out, self.done, self.number = None, done, 0

    def add(self, data: bytes) -> None:
        if self.out is None:
            name = f"part-{self.shard:06d}-{self.number:05d}.warc.gz"
            self.temporary, self.name = f"_temporary_warc/{self.attempt}-{name}", name
            self.out = self.files.open_output_stream(posixpath.join(self.root, self.temporary), compression=None)
            self.n = self.size = 0
            self.sha = hashlib.sha256()
        packed = member(data)
        self.out.write(packed)
        self.sha.update(packed)
        self.n, self.size = self.n + 1, self.size + len(packed)
        if self.size >= self.roll_bytes:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.shard, self.temporary, self.name, self.n, self.size, self.sha.hexdigest()))
            self.out, self.number = None, self.number + 1


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=_FILE_FIELDS)


def revisits(keys: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the pages (page_id, digest) whose payload a larger page id has too; distinct."""
    counts = common.materialise(keys.groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("refers_to")), "payloads")
    again = counts.where("n > 1 and refers_to is not null")
    found = common.join_unique(keys, again.select("digest", "refers_to"), "digest", again, keys.count()).where("refers_to is not null and (page_id is null or page_id < refers_to)")
    return found.select("page_id", "digest", "refers_to").distinct()


def bounds(keys: DataFrame, shards: int) -> list[tuple[int, str]]:
    """The least (page_id, start of the digest) of each shard but the first: fewer than ``shards``, ascending, so that each shard has about as many of ``keys``.

    Ids are counted in bins of equal width, and a bin with more than a part of a shard's share in finer bins again, in proportion to its shares, down to a
    single id and then its digests' first three digits. All counts are exact; what reaches the driver is in proportion to the number of shards.
    A null id comes first, as the least id.
    """
    spark = keys.sparkSession
    least, largest, total = keys.agg(F.min("page_id"), F.max("page_id"), F.count("*")).first()
    share = -(-total // shards)
    small = max(1, share // max(EVEN, min(256, BINS // shards)))
    nulls = keys.where("page_id is null").count()
    bins: list[tuple[int, str, int]] = []  # (first id, first digest, rows)
    full: list[int] = []  # ids with too many rows
    bins += [(_NULL, "", nulls)] if 0 < nulls <= share else []
    todo = [(0, largest - least + 1, total)] if least is not None else []  # (first offset from the least id, ids, rows)
    while todo:
        todo.sort()
        widths = [max(1, -(-n // min(BINS, max(16, FINER * rows // share, BINS // len(todo))))) for _, n, rows in todo]
        firsts, last, width = (np.array(v, np.uint64) for v in ([f for f, _, _ in todo], [n - 1 for _, n, _ in todo], widths))

        @F.pandas_udf("long")
        def start_of(page_id: pd.Series) -> pd.Series:
            """The offset of the id's bin, as its 64 bits; none where the id is in no bin that is counted."""
            off = page_id.to_numpy(np.int64).view(np.uint64) - np.array(least, np.int64).view(np.uint64)
            k = np.maximum(np.searchsorted(firsts, off, side="right").astype(np.int64) - 1, 0)
            within = off - firsts[k]
            found = pd.Series((firsts[k] + within // width[k] * width[k]).view(np.int64)).astype("Int64")
            return found.where((off >= firsts[k]) & (within <= last[k]))

        counted = keys.where("page_id is not null").select(start_of("page_id").alias("start")).where("start is not null").groupBy("start").count().collect()
        before, todo = todo, []
        for r in counted:
            at, n = r["start"] % (1 << 64), r["count"]
            of = bisect_right(before, at, key=lambda v: v[0]) - 1
            if n <= small or (widths[of] == 1 and n <= share):
                bins.append((least + at, "", n))
            elif widths[of] > 1:
                todo.append((at, min(widths[of], before[of][0] + before[of][1] - at), n))
            else:
                full.append(least + at)
    if full:
        asked = spark.createDataFrame([(i,) for i in full], "page_id long")  # at most one per shard
        found = keys.join(F.broadcast(asked), "page_id").groupBy("page_id", F.substring("digest", 1, 3).alias("d")).count().collect()
        bins += [(r["page_id"], r["d"], r["count"]) for r in found]
    if nulls > share:
        bins += [(_NULL, r["d"], r["count"]) for r in keys.where("page_id is null").select(F.substring("digest", 1, 3).alias("d")).groupBy("d").count().collect()]
    out, held = [], 0
    for at, sha, n in sorted(bins):
        if held and held + n > share and len(out) < shards - 1:
            out.append((at, sha))
            held = 0
        held += n
    return out


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", payload: str = "html", shards: int | None = None, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write the archive under ``path`` (a URI that all executors reach) and return its manifest as a DataFrame."""
    spark = pages.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = common.in_small_batches(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary").alias("payload"))
    own = own.withColumn("digest", F.sha1("payload"))
    keys = common.materialise(own.select("page_id", "digest"), "payload-digests")
    firsts = bounds(keys, n)
    of_id, of_digest = np.array([i for i, _ in firsts], np.int64), np.array([d for _, d in firsts], dtype=object)

    @F.pandas_udf("int")
    def shard_of(page_id: pd.Series, digest: pd.Series) -> pd.Series:
        """Bounds at or before (page_id, start of the digest); bounds with one id are told apart by the digest."""
        out = np.searchsorted(of_id, page_id.to_numpy(), side="right")
        for i in np.unique(of_id[of_digest != ""]):
            mine, there = (page_id == i).to_numpy(), np.flatnonzero(of_id == i)
            out[mine] = there[0] + np.searchsorted(of_digest[there].astype(str), digest[mine].to_numpy().astype(str), side="right")
        return pd.Series(out.astype(np.int32))

    roles = revisits(keys).select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "refers_to")
    rows = own.withColumn("refers_to", F.lit(None).cast("long")).unionByName(roles)
    rows = rows.withColumn("shard", shard_of(F.coalesce("page_id", F.lit(_NULL)), F.substring("digest", 1, 3)))
    # Of equal ids and digests, the row that says that they are revisits comes first.
    order = [F.col("page_id").asc_nulls_first(), "digest", F.col("payload").isNotNull(), "url"]
    ranged = rows.repartitionById(n, F.col("shard")).sortWithinPartitions("shard", *order).select("page_id", "url", "payload", "digest", "refers_to", "shard")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, last, refer, done = None, None, None, []
        for b in batches:
            for page_id, link, body, sha, to, shard in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None or out.shard != shard:
                    if out:
                        out.close()
                    out = _Roller(path, shard, roll_bytes, done)
                if body is None:
                    refer = (page_id, sha, to)
                    continue
                linked = refer is not None and refer[:2] == (page_id, sha)
                same, last = last == (page_id, sha), (page_id, sha)
                payload_digest = base64.b32encode(bytes.fromhex(sha)).decode()
                out.add(record(page_id, link, body, payload_digest, refer[2] if linked else page_id, linked or same))
        if out:
            out.close()
        yield _table(done)

    pfs_, root = pfs.FileSystem.from_uri(path)
    pfs_.create_dir(posixpath.join(root, "_temporary_warc"), recursive=True)
    manifest = common.materialise(ranged.mapInArrow(write, _MANIFEST), "warc-manifest")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pfs.FileSystem.from_uri(path)
        for b in batches:
            for temporary, name in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                old, new = posixpath.join(root, temporary), posixpath.join(root, name)
                if files.get_file_info(old).type == pfs.FileType.File:
                    files.move(old, new)
                elif files.get_file_info(new).type != pfs.FileType.File:
                    raise FileNotFoundError(old)
            yield b

    committed = common.materialise(manifest.mapInArrow(commit, _MANIFEST), "warc-committed")
    total = committed.agg(F.count("*"), F.sum("n_records"), F.sum("n_bytes")).first()
    committed.drop("temporary").write.json(posixpath.join(path, "manifest"))
    with pfs_.open_output_stream(posixpath.join(root, "_MANIFEST.json"), compression=None) as f:
        f.write(json.dumps({"files": total[0], "records": total[1] or 0, "bytes": total[2] or 0, "list": "manifest"}).encode())
    pfs_.delete_dir(posixpath.join(root, "_temporary_warc"))
    return committed


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records of a binary stream of gzip members, one at a time."""
    raw, buffer, z = b"", bytearray(), zlib.decompressobj(31)
    while True:
        if not raw:
            raw = stream.read(1 << 20)
            if not raw:
                return
        buffer += z.decompress(raw)
        raw = b""
        if z.eof:
            raw, z = z.unused_data, zlib.decompressobj(31)
            head, _, rest = bytes(buffer).partition(b"\r\n\r\n")
            lines = head.decode("utf-8", "surrogatepass").split("\r\n")
            headers = dict(x.split(": ", 1) for x in lines[1:])
            yield headers, rest[: int(headers["Content-Length"])]
            buffer = bytearray()


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of every record; a revisit's payload is null.

    Only files of the manifest are read, an archive without one (not written to its end) is an error, and a response whose payload does not have its digest fails the read.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pfs.FileSystem.from_uri(path)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows, size = [], 0
                with files.open_input_stream(posixpath.join(root, name), compression=None) as f:
                    for h, block in read_records(f):
                        http, _, body = block.partition(b"\r\n\r\n")
                        n = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
                        revisit, sha = h["WARC-Type"] == "revisit", h["WARC-Payload-Digest"].removeprefix("sha1:")
                        if not revisit and (digest(body) != sha or len(body) != n):
                            raise ValueError(f"{name}: the payload of {h['WARC-Record-ID']} does not have its digest")
                        page, to = h.get("X-Page-ID"), h.get("X-Refers-To-Page-ID")
                        rows.append((page and int(page), h.get("WARC-Target-URI"), n, sha, h["WARC-Type"], to and int(to), None if revisit else body))
                        size += len(body)
                        if size > 8 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                yield batch(rows)

    there, top = pfs.FileSystem.from_uri(path)
    if there.get_file_info(posixpath.join(top, "_MANIFEST.json")).type != pfs.FileType.File:
        raise FileNotFoundError(f"no _MANIFEST.json under {path}: the archive was not written to its end")
    listed = spark.read.schema("name string, n_bytes long").json(posixpath.join(path, "manifest")).select("name")
    return listed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(read, schema)
