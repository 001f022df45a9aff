"""WARC archives with a two-level capture index.

Captures are sorted by reversed-host URL key. Each task writes its range of keys as a WARC file
of gzip members in the shared folder, and beside it the range's index lines in
compressed blocks of BLOCK_LINES. The block directory, one row for a block, is a small
sorted table of one file for each range. A lookup sorts its keys the same way,
binary-searches the ranges' bounds and then the one or two directory files that its
own keys need, and reads the blocks and then the records by byte range.

Files bear names of their own for each attempt of a task, and only rows of
attempts that succeeded name them, so a lost executor leaves no half file in use.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import kind
from skyloom.scratch import scratch_path, small, store

BLOCK_LINES = 512
DATE = "2020-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def reversed_host_key(url: Column) -> Column:
    """`com,example,www)/path?query`: the host's labels in reverse, lower case, without scheme, user, port or fragment. Null and what has no host sort first, by their text."""
    text = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r"#.*$", "")
    host = F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/:?]*)", 1)
    rest = F.regexp_replace(text, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", "")
    turned = F.array_join(F.reverse(F.split(F.lower(host), r"\.")), ",")
    return F.regexp_replace(F.when(host == "", F.concat(F.lit(")"), text)).otherwise(F.concat(turned, F.lit(")"), F.when(rest == "", "/").otherwise(rest))), r"\s", "%20")


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, number: str, url: str, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC record, gzip-compressed by itself. A revisit has no payload, but the digest and length of the one that it repeats."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:skyloom:page:{number}>", f"WARC-Date: {DATE}"]
    lines += [f"WARC-Target-URI: {re.sub(r'[\r\n]', '%0A', url)}", f"WARC-Payload-Digest: sha1:{digest32(payload)}"]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(payload)}\r\n\r\n".encode()
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:skyloom:page:{refers_to}>"]
    else:
        body += payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return gzipped("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n")


def gzipped(data: bytes) -> bytes:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def parse(member: bytes) -> dict:
    """Headers and payload of a record."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields | {"http": http.decode(), "payload": payload}


class Files:
    """Files of the shared folder, on whichever file system its URI names."""

    def __init__(self, uri: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(uri)
        self.open: dict = {}

    def create(self, name: str):
        self.fs.create_dir(self.root, recursive=True)
        return self.fs.open_output_stream(posixpath.join(self.root, name), compression=None)

    def read(self, name: str, at: int, size: int) -> bytes:
        """A byte range. The last few files stay open."""
        if name not in self.open:
            if len(self.open) >= 8:
                self.open.pop(next(iter(self.open))).close()
            self.open[name] = self.fs.open_input_file(posixpath.join(self.root, name))
        return self.open[name].read_at(size, at)


class Archive:
    """Where WARC files, index blocks and the block directory are."""

    def __init__(self, folder: str, directory: DataFrame, partitions: int):
        self.folder, self.directory, self.partitions = folder, directory, partitions

    def lookup(self, keys: DataFrame) -> DataFrame:
        """page, kind, url, digest, refers_to (text), payload (null for a revisit) of every capture with a key (`key`) of `keys`, a null key included.

        Keys that repeat find their captures once for each time, except that one task
        looks up neighbours once; give distinct keys. Unknown keys find nothing. A
        payload that doesn't have its record's digest ends the job.
        """
        folder = self.folder
        # One row for each range that was written: no more than `partitions`.
        files = self.directory.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.min("first").alias("first"), F.max("last").alias("last")).collect()
        ranges = sorted((r["last"], r["first"], r["path"]) for r in files)

        def blocks_from(key: str) -> Iterator[dict]:
            """Directory rows in order, from the first block that may hold the key on; one directory file at a time is held."""
            import pyarrow.parquet as pq
            from pyarrow import fs

            for last, _, path in ranges[bisect_left(ranges, (key,)) :]:
                source, name = fs.FileSystem.from_uri(path)
                part = pq.read_table(name, filesystem=source).sort_by([("first", "ascending"), ("at", "ascending")])
                ends = part.column("last").to_pylist()
                yield from part.slice(bisect_left(ends, key)).to_pylist()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            files, held, last, ahead, block = Files(folder), [], None, None, None
            rows: list[tuple] = []
            for batch in batches:
                for key in batch["key"]:
                    if key == last:
                        continue
                    last, ahead = key, ahead or blocks_from(key)
                    # The block at hand, then the following ones, as far as they begin no later than the key.
                    while True:
                        if block and block["first"] > key:
                            break
                        if block and block["last"] >= key:
                            held = held or zlib.decompress(files.read(block["file"], block["at"], block["size"]), 31).decode().split("\n")
                            i = bisect_left(held, key + " ")
                            while i < len(held) and held[i].startswith(key + " "):
                                _, warc, start, size = held[i].rsplit(" ", 3)
                                rows.append(found(parse(files.read(warc, int(start), int(size)))))
                                i += 1
                            if block["last"] > key:
                                break
                        block, held = next(ahead, None), []
                        if not block:
                            break
                    if len(rows) >= 256:
                        yield pd.DataFrame(rows, columns=COLUMNS)
                        rows = []
            yield pd.DataFrame(rows, columns=COLUMNS)

        ordered = keys.select(F.coalesce("key", F.lit("")).alias("key")).repartitionByRange(self.partitions, "key").sortWithinPartitions("key")
        return ordered.mapInPandas(run, "page string, kind string, url string, digest string, refers_to string, payload binary")


COLUMNS = ["page", "kind", "url", "digest", "refers_to", "payload"]


def found(got: dict) -> tuple:
    """A parsed record as a row. A response's digest is that of the payload as read, which must be what the header says."""
    number = lambda name: got[name].removeprefix("<urn:skyloom:page:").removesuffix(">") if name in got else None
    response, stated = got["WARC-Type"] == "response", got["WARC-Payload-Digest"].removeprefix("sha1:")
    digest = digest32(got["payload"]) if response else stated
    if digest != stated:
        raise ValueError(f"the payload of {got['WARC-Record-ID']} has another digest than its record says")
    return number("WARC-Record-ID"), got["WARC-Type"], got["WARC-Target-URI"], digest, number("WARC-Refers-To"), got["payload"] if response else None


def capture_key(url: Column, page: Column) -> Column:
    """Sort key of a capture: reversed-host key, then the page's number."""
    return F.concat_ws(" ", reversed_host_key(url), page)


def page_number(page_id: Column) -> Column:
    """A page_id as text; `none` for null."""
    return F.coalesce(page_id.cast("string"), F.lit("none"))


def judged(pages: DataFrame, least: int) -> DataFrame:
    """page, url, payload, kind and refers_to of each row.

    Of equal payloads of `least` bytes or more, those of the largest page_id (nulls
    are least) are responses and all others revisits of it.
    """
    rows = pages.withColumn("_sha", F.sha1("payload"))
    best = rows.where(F.octet_length("payload") >= least).groupBy("_sha").agg(F.max("page_id").alias("_best"), F.count("*").alias("_n")).where("_n > 1")
    best = store(best.drop("_n"), "repeats")
    # Where repeated payloads are few, as counted, payloads aren't shuffled for this.
    rows = rows.join(small(best, best.count()), "_sha", "left")
    again = F.col("_best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_best"))
    return rows.select(
        page_number(F.col("page_id")).alias("page"), F.coalesce("url", F.lit("")).alias("url"), "payload",
        F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, page_number(F.col("_best"))).alias("refers_to"),
    )


def write_archive(pages: DataFrame, least: int = 0) -> Archive:
    """Write `pages` (page_id, url, payload as bytes) as WARC files with their index."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = judged(pages, least).withColumn("key", capture_key(F.col("url"), F.col("page")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, files = uuid.uuid4().hex, Files(folder)
        out, at, lines, blocks, index_at, index = None, 0, [], [], 0, None

        def flush() -> None:
            nonlocal lines, index_at
            data = gzipped("\n".join(lines).encode())
            index.write(data)
            key = lambda line: line.rsplit(" ", 3)[0]
            blocks.append((key(lines[0]), key(lines[-1]), f"{name}.cdx.gz", index_at, len(data), len(lines)))
            index_at, lines = index_at + len(data), []

        for batch in batches:
            out, index = out or files.create(f"{name}.warc.gz"), index or files.create(f"{name}.cdx.gz")
            for x in batch.itertuples(index=False):
                data = record(x.kind, x.page, x.url, bytes(x.payload), x.refers_to)
                out.write(data)
                lines.append(f"{x.key} {name}.warc.gz {at} {len(data)}")
                at += len(data)
                if len(lines) == BLOCK_LINES:
                    flush()
        if lines:
            flush()
        for f in (out, index):
            if f:
                f.close()
        yield pd.DataFrame(blocks, columns=["first", "last", "file", "at", "size", "lines"])

    ranged = rows.repartitionByRange(n, "key").sortWithinPartitions("key")
    directory = store(ranged.mapInPandas(run, "first string, last string, file string, at long, size long, lines long"), "directory")
    return Archive(folder, directory, n)


def round_trip(pages: DataFrame, least: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page, as read back from the archives.

    A null html is an empty payload; all empty payloads are equal. A null URL is an
    empty one, a null page_id the least. Rows that repeat the page_id of a response
    and its payload are responses too. Columns beside the three named are not looked at. No
    rows give no rows. A revisit's payload is that of the response it refers to.
    """
    number = kind(pages, page_id)
    plain = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    archive = write_archive(plain, least)
    keys = plain.select(capture_key(F.coalesce("url", F.lit("")), page_number(F.col("page_id"))).alias("key")).distinct()
    read = archive.lookup(keys)
    size, again = F.octet_length("payload"), F.col("kind") == "revisit"
    back = store(read.select("page", "kind", "digest", "refers_to", size.cast("long").alias("size")), "read")
    whole = back.where(~again).select(F.col("page").alias("refers_to"), "digest", F.col("size").alias("whole")).distinct()
    # A revisit's length is that of the response read back that has its id and digest; responses need no partner.
    both = back.where(again).join(small(whole, whole.count()), ["refers_to", "digest"], "left").unionByName(back.where(~again).withColumn("whole", F.lit(None).cast("long")))
    id_of = lambda c: F.when(F.col(c) != "none", F.col(c)).cast(number)
    return both.select(
        id_of("page").alias("page_id"), F.when(again, F.col("whole")).otherwise(F.col("size")).alias("payload_bytes"),
        F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), id_of("refers_to").alias("refers_to"),
    )


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_FIVES = " || ".join(f"substr('{_ALPHABET}', ((v[{g + 1}] >> {s}) & 31) + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT h, max(page_id) AS best FROM p GROUP BY h),
v AS (SELECT page_id, best, strlen(t)::BIGINT AS payload_bytes, list_transform(range(8), lambda g: ('0x' || substr(h, (5 * g + 1)::INT, 5))::INT) AS v FROM p JOIN b USING (h))
SELECT page_id, payload_bytes, {_FIVES} AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to
FROM v
"""
