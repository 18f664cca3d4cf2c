"""Token ids as independent zstandard frames, with a document index, a trailing seek table and checksums.

A file is a series of frames of little-endian unsigned 32-bit ids: each document has its own frame
(several beyond FRAME_BYTES), so that a reader decompresses only what it asks for. After them come
two skippable frames: the index of documents (DOCUMENT records of fixed width in file order, which is
that of doc_id, and their number), and the seek table of the public seekable format: compressed size,
size and low half of the XXH64 of each frame, their number, a flag, the magic number. Frames carry
zstandard's own checksum besides.

Documents are encoded and compressed where they are read; only compressed frames are sorted. Range
partitions (doc_id, hash of the text, place) of about PART_BYTES are written in order and rolled at
ROLL_BYTES or ROLL_DOCS; files are committed as in `warc` (temporary names, renamed by a second job,
manifest), and `files`, a row a file, adds the ids before each. The reader takes ranges of SPLIT_DOCS
documents as its tasks; `fetch` finds single documents by binary search in the index.

Encoding cuts a text before every space between two characters that are surely no white space: there
the byte-level pattern always ends a piece, whatever stands further off, so that a piece's ids can be
remembered (at most MOST_KEPT of them) and equal those of the whole text. All ids come from the library.

Memory: one document with its ids, or one frame when reading, and the index of a file.

Defined cases: a null or empty text is its end id alone; null ids come last; rows of equal id are ordered
by a hash of the text, equal rows each by themselves; an empty table gives no file and an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, small_batches
from .warc import commit, store

END, LEVEL, FRAME_BYTES, MOST_KEPT, KEPT_CHARS = 0, 3, 4 << 20, 1 << 20, 64
PART_BYTES, MOST_PARTS, ROLL_BYTES, ROLL_DOCS, SPLIT_DOCS = 128 << 20, 20_000, 64 << 20, 1 << 18, 8192
#: Fixed values of the seekable format.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_MAGIC, WITH_CHECKSUMS = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1, 0x80
DOCUMENT = np.dtype([("doc_id", "<i8"), ("no_id", "u1"), ("start", "<u8"), ("n", "<u8"), ("offset", "<u8"), ("frame", "<u4")])
SEEK = np.dtype([("packed", "<u4"), ("size", "<u4"), ("sum", "<u4")])
#: Characters that no version of Unicode counts as white space.
SURE = frozenset(map(chr, [*range(0x21, 0x7F), *range(0xA1, 0x250)]))
ENCODED = "doc_id long, no_id boolean, tie long, n long, packed long, frames array<binary>, sizes array<int>, sums array<long>"
WRITTEN = "temporary string, name string, records long, bytes long, sha1 string, tokens long, first long, last long, no_ids long"


class Encoder:
    """Ids of whole texts as bytes. special: read the strings of special tokens as those tokens (the library's default)."""

    def __init__(self, path: str, special: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        vocabulary = self.tokenizer.get_vocab()
        self.lengths = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        self.lengths[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.kept: dict[str, bytes] = {}

    def library(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk of a text, from one call on the whole of it: a token's string has a character for each byte."""
        (found,) = self.tokenizer.encode_batch_fast(["".join(chunks)], add_special_tokens=False)
        ids = np.array(found.ids, dtype="<u4")
        ends = np.cumsum(self.lengths[ids])
        cuts = np.searchsorted(ends, np.cumsum([len(x.encode()) for x in chunks]), side="right") * ids.itemsize
        raw = ids.tobytes()
        return [raw[a:b] for a, b in itertools.pairwise([0, *cuts.tolist()])]

    def encode(self, text: str) -> bytes:
        pieces = text.split(" ")
        ids: list[bytes | None] = list(map(self.kept.get, pieces))
        ids[0] = None  # it has no space before it, the remembered ones have
        missing = [i for i, x in enumerate(ids) if x is None]
        # A space beside anything else than two sure characters ends no piece for certain: what lies around it stays together.
        unsure = {i for i in missing if i and pieces[i][:1] not in SURE} | {i + 1 for i in missing if i + 1 < len(pieces) and pieces[i][-1:] not in SURE}
        to = {}
        if unsure:
            done, starts = -1, []
            for i in sorted(unsure.union(missing)):
                if i > done:
                    start = done = i - 1 if i in unsure else i
                    while done + 1 in unsure:
                        done += 1
                    starts.append(start)
                    to[start] = done
            missing = starts
        chunk = lambda i: (" " if i else "") + (" ".join(pieces[i : to[i] + 1]) if i in to else pieces[i])
        last, between = missing[-1], missing[1:-1]
        new = list(dict.fromkeys(map(chunk, between)))
        first, *found = self.library([chunk(0), *new, *([chunk(last)] if last else [])])
        known = dict(zip(new, found, strict=False))
        ids[0], ids[last] = first, found[-1] if last else first
        for i in between:
            ids[i] = known[chunk(i)]
        for i, end in to.items():
            ids[i + 1 : end + 1] = [b""] * (end - i)
        room = MOST_KEPT - len(self.kept)
        if room > 0:
            self.kept.update([(x[1:], known[x]) for x in new if " " not in x[1:] and len(x) <= KEPT_CHARS and x[-1] in SURE][:room])
        return b"".join(ids)


@functools.lru_cache(maxsize=2)
def encoder_of(path: str, special: bool) -> Encoder:
    """One encoder a Python worker, so that what it remembers serves all tasks of that worker."""
    return Encoder(path, special)


def packed(raw: bytes, compressor: zstandard.ZstdCompressor) -> tuple[list[bytes], list[int], list[int]]:
    parts = [raw[i : i + FRAME_BYTES] for i in range(0, len(raw), FRAME_BYTES)]
    return [compressor.compress(p) for p in parts], [len(p) for p in parts], [xxhash.xxh64(p).intdigest() & 0xFFFFFFFF for p in parts]


def _encode(path: str, special: bool):
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, compressor = encoder_of(path, special), zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        end = struct.pack("<I", END)
        for batch in batches:
            rows = []
            for key, no_id, tie, text in batch.itertuples(index=False):
                raw = encoder.encode(text) + end
                frames, sizes, sums = packed(raw, compressor)
                rows.append((key, no_id, tie, len(raw) // 4, sum(map(len, frames)), frames, sizes, sums))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ENCODED.split(", ")])

    return encode


class Writer:
    """Files of one range after the other."""

    def __init__(self, root: str, part: int, roll: int, most: int):
        import hashlib

        self.fs, self.root = store(root)
        self.part, self.roll, self.most, self.attempt, self.done, self.sha1 = part, roll, most, uuid.uuid4().hex, [], hashlib.sha1
        self.out, self.number = None, 0

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def add(self, key: int, no_id: bool, n: int, frames: list[bytes], sizes: list[int], sums: list[int]) -> None:
        if self.out is not None and (self.size + sum(map(len, frames)) > self.roll or self.docs == self.most):
            self.close()
        if self.out is None:
            self.name = f"tokens-{self.part:06d}-{self.number:05d}.zst"
            self.temporary = f".{self.name}.{self.attempt}.tmp"
            self.out, self.sha = self.fs.open_output_stream(f"{self.root}/{self.temporary}", compression=None), self.sha1()
            self.size = self.tokens = self.docs = self.frames = self.no_ids = 0
            self.index, self.seek, self.first, self.last = bytearray(), bytearray(), None, None
            self.number += 1
        self.index += np.array((key, no_id, self.tokens, n, self.size, self.frames), dtype=DOCUMENT).tobytes()
        for data, size, check in zip(frames, sizes, sums, strict=True):
            self.seek += struct.pack("<III", len(data), size, check)
            self.put(data)
        self.tokens, self.docs, self.frames = self.tokens + n, self.docs + 1, self.frames + len(frames)
        if no_id:
            self.no_ids += 1
        else:
            self.first, self.last = key if self.first is None else self.first, key

    def close(self) -> None:
        if self.out is None:
            return
        self.put(struct.pack("<II", SKIPPABLE_INDEX, len(self.index) + 4) + bytes(self.index) + struct.pack("<I", self.docs))
        self.put(struct.pack("<II", SKIPPABLE_SEEK, len(self.seek) + 9) + bytes(self.seek) + struct.pack("<IBI", self.frames, WITH_CHECKSUMS, SEEK_MAGIC))
        self.out.close()
        self.done.append((self.temporary, self.name, self.docs, self.size, self.sha.hexdigest(), self.tokens, self.first, self.last, self.no_ids))
        self.out = None


def _write(root: str, roll: int, most: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files = Writer(root, TaskContext.get().partitionId(), roll, most)
        for batch in batches:
            for x in batch.itertuples(index=False):
                files.add(int(x.doc_id), bool(x.no_id), int(x.n), list(x.frames), list(x.sizes), list(x.sums))
        files.close()
        yield pd.DataFrame(files.done, columns=[c.split()[0] for c in WRITTEN.split(", ")]).astype({"first": "Int64", "last": "Int64"})

    return write


def write_tokens(docs: DataFrame, root: str, tokenizer: str, special: bool = True, part: int = PART_BYTES, roll: int = ROLL_BYTES, most: int = ROLL_DOCS) -> DataFrame:
    """Writes documents (doc_id, text) below root and commits. Returns a row a file: name, records, tokens, first and last id, no_ids, start."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    encoded = scratch.write(rows.mapInPandas(_encode(tokenizer, special), ENCODED), "none")
    parts = max(1, min(MOST_PARTS, -(-(encoded.agg(F.sum("packed")).first()[0] or 0) // part)))
    # Equal rows spread by their place in the file.
    salted = encoded.withColumn("salt", F.hash(F.col("_metadata.file_path"), F.col("_metadata.row_index")))
    order = ["no_id", "doc_id", "tie", "salt"]
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)
    written = scratch.write(salted.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInPandas(_write(root, roll, most), WRITTEN))
    scratch.drop(encoded)
    commit(written.select("temporary", "name", "records", "bytes", "sha1"), root)
    # One row a file: the running sum over them is small whatever the documents.
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    written.select("name", "records", "tokens", "first", "last", "no_ids", before.alias("start")).write.mode("overwrite").json(f"{root}/files")
    return files_of(spark, root)


def files_of(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("name string, records long, tokens long, first long, last long, no_ids long, start long").json(f"{root}/files")


class Reader:
    """Random access to one file: the tail is read at once, frames when a document asks for them."""

    def __init__(self, file):
        self.file, end = file, file.size()
        frames, flags, magic = struct.unpack("<IBI", self.read(end - 9, 9))
        if magic != SEEK_MAGIC or flags != WITH_CHECKSUMS:
            raise ValueError("no seek table at the end of the file")
        at = end - 9 - frames * SEEK.itemsize
        (docs,) = struct.unpack("<I", self.read(at - 12, 4))
        self.frames, self.docs, self.seek_at, self.index_at = frames, docs, at, at - 12 - docs * DOCUMENT.itemsize

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(n)
        if len(data) != n:
            raise ValueError("the file is cut off")
        return data

    def index(self, lo: int, hi: int) -> np.ndarray:
        return np.frombuffer(self.read(self.index_at + lo * DOCUMENT.itemsize, (hi - lo) * DOCUMENT.itemsize), dtype=DOCUMENT)

    def find(self, key: int) -> range:
        """Places of the documents of an id, by binary search over the fixed records."""

        def bound(after: bool) -> int:
            lo, hi = 0, self.docs
            while lo < hi:
                middle = (lo + hi) // 2
                x = self.index(middle, middle + 1)[0]
                below = not x["no_id"] and (x["doc_id"] <= key if after else x["doc_id"] < key)
                lo, hi = (middle + 1, hi) if below else (lo, middle)
            return lo

        return range(bound(False), bound(True))

    def documents(self, lo: int, hi: int) -> Iterator[tuple[np.void, Iterator[bytes]]]:
        """Index records of documents lo to hi, each with its frames' ids as bytes, checked. Frames must be drained in order."""
        if lo >= hi:
            return
        known = self.index(lo, min(hi + 1, self.docs))
        last = int(known[hi - lo]["frame"]) if hi < self.docs else self.frames
        first = int(known[0]["frame"])
        seek = np.frombuffer(self.read(self.seek_at + first * SEEK.itemsize, (last - first) * SEEK.itemsize), dtype=SEEK)
        unpack = zstandard.ZstdDecompressor()

        def frames(a: int, b: int, at: int) -> Iterator[bytes]:
            for s in seek[a - first : b - first]:
                raw = unpack.decompress(self.read(at, int(s["packed"])), max_output_size=int(s["size"]))
                if len(raw) != s["size"] or xxhash.xxh64(raw).intdigest() & 0xFFFFFFFF != s["sum"]:
                    raise ValueError("a frame does not match its checksum")
                at += int(s["packed"])
                yield raw

        for i in range(hi - lo):
            end = int(known[i + 1]["frame"]) if i + 1 < len(known) else self.frames
            yield known[i], frames(int(known[i]["frame"]), end, int(known[i]["offset"]))


def _opened(root: str):
    files, at = store(root)
    return lambda name: files.open_input_file(f"{at}/{name}")


def _rows(root: str, of, columns: list[str], places=None, chunk: int = 4 << 20):
    """Rows of documents: id, start, n and of(frames). places: a function of the reader and the split's row that gives ranges."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened = _opened(root)
        table = lambda rows: pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})
        for batch in batches:
            for split in batch.itertuples(index=False):
                with opened(split.name) as file:
                    reader, rows, held = Reader(file), [], 0
                    for span in places(reader, split) if places else [range(split.lo, min(split.lo + SPLIT_DOCS, reader.docs))]:
                        for doc, frames in reader.documents(span.start, span.stop):
                            rows.append((None if doc["no_id"] else int(doc["doc_id"]), int(split.start + doc["start"]), int(doc["n"]), of(frames)))
                            held += 64 + 4 * int(doc["n"])
                            if held > chunk:
                                yield table(rows)
                                rows, held = [], 0
                    yield table(rows)

    return read


def checksum(frames: Iterator[bytes]) -> int:
    crc = 0
    for raw in frames:
        crc = zlib.crc32(raw, crc)
    return crc


def numbers(frames: Iterator[bytes]) -> list[int]:
    return np.frombuffer(b"".join(frames), dtype="<u4").astype(np.int64)


def splits(spark: SparkSession, root: str) -> DataFrame:
    lo = F.explode(F.sequence(F.lit(0).cast("long"), F.col("records") - 1, F.lit(SPLIT_DOCS).cast("long")))
    out = files_of(spark, root).select("name", "start", lo.alias("lo"))
    return out.repartition(max(1, min(MOST_PARTS, out.count())), "name", "lo")


def read_checksums(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read from the files."""
    columns = ["doc_id", "start", "n_tokens", "ids_crc32"]
    return splits(spark, root).mapInPandas(_rows(root, checksum, columns), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_tokens(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, start, n_tokens and ids of every document."""
    columns = ["doc_id", "start", "n_tokens", "ids"]
    return splits(spark, root).mapInPandas(_rows(root, numbers, columns), "doc_id long, start long, n_tokens long, ids array<long>")


def fetch(spark: SparkSession, root: str, ids: list[int]) -> DataFrame:
    """read_tokens for the ids of a stated list: files by their ranges, documents by binary search, only their frames decompressed."""
    wanted = sorted(set(ids))
    between = F.exists(F.lit(wanted) if wanted else F.array().cast("array<long>"), lambda x: (x >= F.col("first")) & (x <= F.col("last")))
    files = files_of(spark, root).where(between).select("name", "start")
    columns = ["doc_id", "start", "n_tokens", "ids"]
    return files.mapInPandas(_rows(root, numbers, columns, lambda reader, _: map(reader.find, wanted)), "doc_id long, start long, n_tokens long, ids array<long>")


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    spark = docs.sparkSession
    root = f"{Scratch(spark).root}/tokens"  # goes when the session's process ends
    write_tokens(docs, root, tokenizer)
    return read_checksums(spark, root)
