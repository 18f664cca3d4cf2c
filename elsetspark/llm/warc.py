"""Deterministic sharded WARC writer and its reader.

Records are dealt to shards by ranges of (page_id, hash of url and payload), so that rows without
an id, or with one id, spread over shards like any others. The bounds come from a hash-chosen,
bounded sample of these keys and depend on the table alone. A shard is sorted and written as one
gzip member a record; a file is rolled before its compressed size would pass ROLL_BYTES. Headers,
record ids and digests are generated from the content, and dates are a parameter, so that equal
tables give equal files.

Commit: tasks write under temporary names that name their attempt; what the successful attempts
report is a table in the shared folder. A second job renames these files, each task its own, and may
be repeated at any point; the manifest (names, records, bytes, SHA-1) is written by Spark as JSON
lines, after it manifest.json with the totals, and what lost attempts left is removed.

Of records with equal payloads of at least REVISIT_BYTES bytes, that with the largest page_id is
the response and the others are revisits of it; smaller ones are all responses.

Memory: one record, and one file of about ROLL_BYTES when reading back. The driver gets the totals
and the sampled keys.

Defined cases: null html is an empty payload; null ids sort last and may be a response only where
a group has no id; of repeated ids that could be the response, the first by url is (null urls last);
null urls are written as urn:page; an empty table gives no file and an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, remove, small_batches

REVISIT_BYTES, ROLL_BYTES, SHARD_BYTES, MOST_SHARDS, SAMPLE_KEYS, LEVEL = 1000, 16 << 20, 4 << 20, 4096, 50_000, 4
DATE, NAMESPACE = "2024-01-01T00:00:00Z", uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "temporary string, name string, records long, bytes long, sha1 string"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def store(path: str):
    """pyarrow's file system of a Hadoop path, and the path in it. Works where the path is shared, in any process."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://").replace("file:///", "/").replace("file:/", "/"))


def record_id(page_id: int | None, url: str | None, digest: str, copy: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page_id}:{digest}:{url}' + (f'#{copy}' if copy else ''))}>"


def record(page_id: int | None, url: str | None, payload: bytes, copy: int, refers: tuple | None) -> bytes:
    """One WARC/1.1 record. refers: (page_id, url) of the response that this revisits."""
    sha = hashlib.sha1(payload).hexdigest()
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else f"urn:page:{page_id}"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers is None:
        block += payload
    sha32 = lambda x: base64.b32encode(x).decode()
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, url, sha, copy)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{sha32(bytes.fromhex(sha))}", f"WARC-Block-Digest: sha1:{sha32(hashlib.sha1(block).digest())}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(*refers, sha)}", f"WARC-Refers-To-Date: {DATE}"]
        head += [f"X-Refers-To-Page-ID: {refers[0]}"] if refers[0] is not None else []
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


class Roller:
    """Files of one shard after the other, rolled by compressed size."""

    def __init__(self, root: str, roll: int):
        self.fs, self.root = store(root)
        self.roll, self.attempt, self.done = roll, uuid.uuid4().hex, []
        self.out = self.shard = None
        self.part = 0

    def add(self, shard: int, data: bytes) -> None:
        packed = gzip.compress(data, LEVEL, mtime=0)
        if self.out is not None and (shard != self.shard or self.size + len(packed) > self.roll):
            self.close()
        if shard != self.shard:
            self.shard, self.part = shard, 0
        if self.out is None:
            self.name = f"shard-{shard:05d}-{self.part:05d}.warc.gz"
            self.temporary = f".{self.name}.{self.attempt}.tmp"
            self.out, self.size, self.records, self.sha = self.fs.open_output_stream(f"{self.root}/{self.temporary}", compression=None), 0, 0, hashlib.sha1()
            self.part += 1
        self.out.write(packed)
        self.sha.update(packed)
        self.size += len(packed)
        self.records += 1

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.temporary, self.name, self.records, self.size, self.sha.hexdigest()))
            self.out = None


def writer(root: str, roll: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by shard, page_id, url, digest, kind; kind 0 names the response of a group, kind 1 is a record."""
        files = Roller(root, roll)
        last = keeper = None
        copies = 0
        for batch in batches:
            for shard, no_id, page_id, digest, kind, url, html, keep_no, keep_id, keep_url in batch[["shard", "no_id", "page_id", "digest", "kind", "url", "html", "keep_no", "keep_id", "keep_url"]].itertuples(index=False):
                page = None if no_id else int(page_id)
                if (page, url, digest) != last:
                    last, keeper, copies = (page, url, digest), None, 0
                if kind == 0:
                    keeper = (None if keep_no else int(keep_id), keep_url)
                    continue
                refers = keeper if keeper is not None and (keeper != (page, url) or copies) else None
                files.add(int(shard), record(page, url, (html or "").encode("utf-8", "replace"), copies, refers))
                copies += 1
        files.close()
        yield pd.DataFrame(files.done, columns=["temporary", "name", "records", "bytes", "sha1"])

    return write


def write_archives(pages: DataFrame, root: str, roll: int = ROLL_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) below root and commits. Returns the manifest: name, records, bytes, sha1 of each file."""
    spark = pages.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("long").alias("n"))
    light = rows.select("page_id", "url", "digest", "n")
    key = F.struct(F.col("page_id").isNull().alias("no"), F.coalesce("page_id", F.lit(0)).alias("id"), F.xxhash64("url", "digest").alias("x"))
    total = light.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("bytes")).first()
    shards = max(1, min(MOST_SHARDS, -(-total["bytes"] // SHARD_BYTES)))
    every = max(1, total["rows"] // SAMPLE_KEYS)
    chosen = light.where(F.pmod(F.xxhash64("page_id", "url", "digest"), F.lit(every)) == 0).select(key.alias("k")).distinct()
    keys = sorted(tuple(r["k"]) for r in chosen.collect())
    bounds = sorted({keys[i * len(keys) // shards] for i in range(1, shards)}) if keys else []
    edges = F.array(*[F.struct(F.lit(no).alias("no"), F.lit(i).cast("long").alias("id"), F.lit(x).cast("long").alias("x")) for no, i, x in bounds])
    # Number of bounds at or below the key: binary search over a literal array.
    halves = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    shard = F.aggregate(halves, F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")), lambda s, _: _halve(s, edges, key), lambda s: s["lo"]) if bounds else F.lit(0)

    best = F.min(F.struct(F.col("page_id").isNull().alias("no"), F.bitwise_not("page_id").alias("id"), F.col("url").isNull().alias("no_url"), F.col("url").alias("url")))
    groups = light.where(F.col("n") >= REVISIT_BYTES).groupBy("digest").agg(F.count("*").alias("copies"), best.alias("k")).where("copies > 1")
    keep = groups.select("digest", F.bitwise_not("k.id").alias("keep_id"), F.col("k.url").alias("keep_url"))
    named = light.join(keep, "digest").select("page_id", "url", "digest", "keep_id", "keep_url").distinct()
    empty = lambda t: F.lit(None).cast(t)
    refs = named.select("page_id", "digest", F.lit(0).alias("kind"), "url", empty("string").alias("html"), "keep_id", "keep_url")
    records = rows.select("page_id", "digest", F.lit(1).alias("kind"), "url", "html", empty("long").alias("keep_id"), empty("string").alias("keep_url"))
    dealt = refs.unionByName(records).withColumns({"shard": shard.cast("int"), "no_id": F.col("page_id").isNull(), "keep_no": F.col("keep_id").isNull()})
    dealt = dealt.withColumns({"page_id": F.coalesce("page_id", F.lit(0)), "keep_id": F.coalesce("keep_id", F.lit(0))})
    dealt = dealt.repartition(len(bounds) + 1, "shard").sortWithinPartitions("shard", "no_id", "page_id", F.col("url").asc_nulls_last(), "digest", "kind")
    at, fs = _hadoop(spark, root)
    fs.mkdirs(at)
    files = scratch.write(dealt.mapInPandas(writer(root, roll), MANIFEST))
    return commit(files, root)


def _halve(s, edges, value):
    """One step of a binary search for the number of edges at or below value in [lo, hi]."""
    middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
    open_ = s["lo"] < s["hi"]
    up = F.get(edges, middle) <= value
    return F.struct(F.when(open_ & up, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(open_ & ~up, middle).otherwise(s["hi"]).alias("hi"))


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def renamer(root: str):
    def rename(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Gives files their names. A file that has it already was named by an attempt before this one."""
        files, at = store(root)
        for batch in batches:
            for temporary, name in zip(batch["temporary"], batch["name"], strict=True):
                if files.get_file_info(f"{at}/{temporary}").is_file:
                    files.move(f"{at}/{temporary}", f"{at}/{name}")
                elif not files.get_file_info(f"{at}/{name}").is_file:
                    raise OSError(f"{name} is lost")
            yield batch[["name", "records", "bytes", "sha1"]]

    return rename


def commit(files: DataFrame, root: str) -> DataFrame:
    """Renames what successful attempts wrote, writes the manifest and last manifest.json; other temporary files go."""
    spark = files.sparkSession
    kind = "name string, records long, bytes long, sha1 string"
    files.mapInPandas(renamer(root), kind).write.mode("overwrite").json(f"{root}/manifest")
    at, fs = _hadoop(spark, f"{root}/.*.tmp")
    for left in fs.globStatus(at) or []:
        remove(spark, left.getPath().toString())
    out = spark.read.schema(kind).json(f"{root}/manifest")
    total = out.agg(F.count("*").alias("files"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    at, fs = _hadoop(spark, f"{root}/manifest.json")
    stream = fs.create(at, True)
    stream.write(bytearray(json.dumps(total.asDict()).encode()))
    stream.close()
    return out


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, streamed: one record in memory."""
    with gzip.GzipFile(fileobj=io.BytesIO(data)) as stream:
        while stream.readline():  # the version
            headers: dict[str, str] = {}
            while (line := stream.readline()) not in (b"\r\n", b""):
                key, _, value = line.decode().rstrip("\r\n").partition(": ")
                headers[key] = value
            block = stream.read(int(headers["Content-Length"]))
            if stream.read(4) != b"\r\n\r\n":
                raise ValueError(f"record {headers.get('WARC-Record-ID')} is cut off")
            yield headers, block


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for content in batch["content"]:
            rows = []
            for headers, block in parse(content):
                head, _, payload = block.partition(b"\r\n\r\n")
                sha = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                size = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length: ")).split(b": ")[1])
                if base64.b32encode(hashlib.sha1(block).digest()).decode() != headers["WARC-Block-Digest"].removeprefix("sha1:") or headers["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != sha):
                    raise ValueError(f"record {headers['WARC-Record-ID']} does not match its digests")
                number = lambda k: int(headers[k]) if k in headers else None  # noqa: E731, B023
                rows.append((number("X-Page-ID"), headers["WARC-Target-URI"], size, sha, headers["WARC-Type"], number("X-Refers-To-Page-ID")))
            out = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])
            yield out.astype({"page_id": "Int64", "refers_to": "Int64"})


def read_archives(spark: SparkSession, root: str) -> DataFrame:
    """A row for each record of the archives below root, checked against its digests."""
    small_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(root).select("content")
    return files.mapInPandas(_read, READ)


def digest(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    root = f"{Scratch(spark).root}/warc"  # goes when the session's process ends
    write_archives(pages, root)
    return read_archives(spark, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM g
"""
