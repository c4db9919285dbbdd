"""Token ids in files of fixed-width bit-packed blocks.

A file holds the ids of consecutive documents.  Every id takes the same number
of bits, the fewest that hold the vocabulary, so the place of any id follows from
its index.  Ids are packed in blocks; eight ids fill a whole number of bytes, and
packing and unpacking are array operations over eight columns.

Layout, little-endian: magic, bits, ids per block, number of documents, number of
ids; the offset of every block; the id count at the end of every document; the
document keys; the blocks.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.pieces import splitter
from prosegauge.llm.shared import shared_folder
from prosegauge.llm.textscan import text_blocks

MAGIC = b"PGIDS001"
HEAD = struct.Struct("<8sIIQQ")
#: Ids per block (a multiple of 8), and UTF-8 bytes of text per file.
BLOCK_IDS = 1 << 14
FILE_BYTES = 16 << 20
CACHED = 500_000
#: Stands for a null document key.
NO_KEY = -(2**63)
MANIFEST = "doc_count long, id_count long, path string, part int"


def bits_for(size: int) -> int:
    """Bits that hold every id below `size`."""
    return max(1, int(size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as consecutive fields of `bits` bits, filled up with zeros to eight ids."""
    groups = np.zeros((-(-len(ids) // 8), 8), np.uint64)
    groups.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(groups), bits + 8), np.uint8)
    for k in range(8):
        byte, shift = divmod(k * bits, 8)
        field = groups[:, k] << np.uint64(shift)
        for j in range((bits + shift + 7) // 8):
            out[:, byte + j] |= ((field >> np.uint64(8 * j)) & np.uint64(255)).astype(np.uint8)
    return out[:, :bits].tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first `n` ids of packed data."""
    groups = np.frombuffer(data, np.uint8).reshape(-1, bits).astype(np.uint64)
    ids = np.zeros((len(groups), 8), np.uint32)
    for k in range(8):
        byte, shift = divmod(k * bits, 8)
        field = np.zeros(len(groups), np.uint64)
        for j in range((bits + shift + 7) // 8):
            field |= groups[:, byte + j] << np.uint64(8 * j)
        ids[:, k] = (field >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
    return ids.reshape(-1)[:n]


class IdFile:
    """Random access to one file through any object with `read_at(size, offset)`."""

    def __init__(self, source) -> None:
        self.source = source
        magic, self.bits, self.per_block, self.n_docs, self.n_ids = HEAD.unpack(source.read_at(HEAD.size, 0))
        if magic != MAGIC:
            raise ValueError("not a file of packed token ids")
        n_blocks = -(-self.n_ids // self.per_block)
        read = lambda n, at: np.frombuffer(source.read_at(8 * n, at), np.int64)
        self.offsets = read(n_blocks + 1, HEAD.size)
        self.ends = read(self.n_docs, HEAD.size + 8 * (n_blocks + 1))
        self.keys = read(self.n_docs, HEAD.size + 8 * (n_blocks + 1 + self.n_docs))

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids `start` to `stop` of the file; reads only the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.per_block, (stop - 1) // self.per_block
        begin = int(self.offsets[first])
        data = self.source.read_at(int(self.offsets[last + 1]) - begin, begin)
        found = unpack(data, self.bits, len(data) * 8 // self.bits)
        return found[start - first * self.per_block : stop - first * self.per_block]

    def document(self, k: int) -> np.ndarray:
        """All ids of the k-th document of the file."""
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


class _Encoder(dict):
    """Packed ids of pre-tokens; what is not in it is encoded and kept."""

    def __init__(self, path: str) -> None:
        self.split = splitter(path)

    def __missing__(self, piece: str) -> bytes:
        if len(self) > CACHED:
            self.clear()
        found = self[piece] = _packed(self.split.encoded([piece])[0])
        return found

    def ids(self, texts: list[str], end: int) -> list[np.ndarray]:
        of, last, found = self.__getitem__, _packed([end]), []
        for text in texts:
            pieces = self.split.pieces(text)
            raw = _packed(self.split.whole(text)) if pieces is None else b"".join(map(of, pieces))
            found.append(np.frombuffer(raw + last, np.uint32))
        return found


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


@lru_cache(maxsize=2)
def _encoder(path: str) -> _Encoder:
    """One per worker process, so that what a task has encoded is known to the next."""
    return _Encoder(path)


def write_file(path: str, documents: Iterator[tuple[int, np.ndarray]], bits: int) -> tuple[int, int]:
    """Write one file; (documents, ids) in it.

    The file is written under a name of this attempt and then renamed, so an
    attempt that is lost or runs twice leaves either nothing or the same file.
    """
    keys, ends, blocks, rest, total = [], [], [], [], 0
    held = 0
    for key, ids in documents:
        keys.append(key)
        total += len(ids)
        ends.append(total)
        rest.append(ids)
        held += len(ids)
        if held >= 64 * BLOCK_IDS:
            ids = np.concatenate(rest)
            cut = len(ids) // BLOCK_IDS * BLOCK_IDS
            blocks += [pack(ids[i : i + BLOCK_IDS], bits) for i in range(0, cut, BLOCK_IDS)]
            rest, held = [ids[cut:]], len(ids) - cut
    if held:
        ids = np.concatenate(rest)
        blocks += [pack(ids[i : i + BLOCK_IDS], bits) for i in range(0, len(ids), BLOCK_IDS)]
    start = HEAD.size + 8 * (len(blocks) + 1 + 2 * len(keys))
    offsets = start + np.cumsum([0, *map(len, blocks)], dtype=np.int64)
    fs, name = pafs.FileSystem.from_uri(path)
    fs.create_dir(name.rpartition("/")[0], recursive=True)
    attempt = f"{name}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(attempt) as out:
        out.write(HEAD.pack(MAGIC, bits, BLOCK_IDS, len(keys), total))
        for part in (offsets, np.asarray(ends, np.int64), np.asarray(keys, np.int64)):
            out.write(part.tobytes())
        for block in blocks:
            out.write(block)
    fs.move(attempt, name)
    return len(keys), total


def uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, parts: int | None = None) -> DataFrame:
    """Encode (doc_id, text) and write the ids in ascending order of doc_id; one manifest row per file.

    Rows are dealt out by ranges of doc_id, a file per range, so files in the
    order of `part` hold the documents in order.  A null text is an empty one and
    has only the end id.  Rows that repeat a doc_id are kept, in the order of
    their texts; a null doc_id comes first and is stored as the smallest long.
    An empty table gives no file.
    """
    split = splitter(tokenizer)
    bits, folder = bits_for(max(split.size, end_id + 1)), uri(path)
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_KEY)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    if parts is None:
        total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = 1 + total // FILE_BYTES
    # The second key spreads a doc_id that very many rows repeat.
    dealt = rows.repartitionByRange(int(parts), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    numbered = dealt.withColumn("part", F.spark_partition_id())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(tokenizer), []

        def documents() -> Iterator[tuple[int, np.ndarray]]:
            for batch in batches:
                for block in text_blocks(batch, "text"):
                    part[:] = [block.column("part")[0].as_py()]
                    yield from zip(block.column("doc_id").to_pylist(), encoder.ids(block.column("text").to_pylist(), end_id), strict=True)

        found = documents()
        first = next(found, None)
        if first is not None:
            name = f"{folder}/part-{part[0]:06d}.ids"
            n_docs, n_ids = write_file(name, chain([first], found), bits)
            yield pa.RecordBatch.from_pydict({"doc_count": [n_docs], "id_count": [n_ids], "path": [name], "part": pa.array(part, pa.int32())})

    manifest = numbered.mapInArrow(write, MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_ids(manifest: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids."""
    as_lists = lambda ids, cuts: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int64)))
    return _read(manifest, "ids", "array<long>", as_lists)


def read_digests(manifest: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids_crc32 (of little-endian 32-bit ids)."""

    def crc(ids: np.ndarray, cuts: np.ndarray) -> pa.Array:
        raw = memoryview(ids.astype("<u4").tobytes())
        return pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.int64())

    return _read(manifest, "ids_crc32", "long", crc)


def _read(manifest: DataFrame, name: str, kind: str, made: Callable[[np.ndarray, np.ndarray], pa.Array]) -> DataFrame:
    """doc_id, start, n_tokens and what `made` makes of a run of ids and its cuts.

    `start` counts the ids of all documents before it.  The manifest has one row
    per file, so its sums are made on the driver; a task reads one file at a time,
    a run of blocks at a time.
    """
    spark = manifest.sparkSession
    files, starts, at = sorted(manifest.collect(), key=lambda r: r["part"]), [], 0
    for file in files:
        starts.append((file["path"], at))
        at += file["id_count"]
    schema = f"doc_id long, start long, n_tokens long, {name} {kind}"
    if not starts:
        return spark.createDataFrame([], schema)
    places = spark.createDataFrame(starts, "path string, start long").repartition(len(starts), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, place = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(place) as source:
                    file, done = IdFile(source), 0
                    begins = np.concatenate([[0], file.ends])
                    while done < file.n_docs:
                        to = max(done + 1, int(np.searchsorted(file.ends, begins[done] + 32 * BLOCK_IDS, "right")))
                        ids = file.ids(int(begins[done]), int(begins[to]))
                        cuts = begins[done : to + 1] - begins[done]
                        keys = pa.array(file.keys[done:to], mask=file.keys[done:to] == NO_KEY)
                        rows = [keys, pa.array(start + begins[done:to]), pa.array(np.diff(cuts)), made(ids, cuts)]
                        yield pa.RecordBatch.from_arrays(rows, ["doc_id", "start", "n_tokens", name])
                        done = to

    return places.mapInArrow(read, schema)


def written_ids(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the files to the shared folder and read them back: doc_id, start, n_tokens, ids_crc32."""
    return read_digests(write_ids(docs, shared_folder(docs.sparkSession, "token-ids"), tokenizer, end_id))
