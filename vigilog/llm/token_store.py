"""Token ids in files: a wavelet matrix for each shard, written and read back by Spark."""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from vigilog.llm.common import chunks, encoded
from vigilog.llm.units import UnitCache, byte_pair_edges, join

END_ID = 0
#: Ids after which a shard is closed; a document is never divided.
SHARD_TOKENS = 1 << 22
#: Units after which a worker's cache of encoded units of text starts anew.
CACHE_UNITS = 2_000_000
MAGIC = b"WVM2"
#: Bytes of a plane that are compressed together: what a look at one bit unpacks.
BLOCK_BYTES = 1 << 13
_BLOCK = 8 * BLOCK_BYTES


class WaveletMatrix:
    """Ids as bit planes, highest bit first; each plane's ids are those of the plane before, zeros first.

    access, rank, select and occurrences look at a block or two of each plane and at the ones before each block,
    which are stored; block(level, k) gives a block, from memory or from a file. decode() unpacks all.
    """

    def __init__(self, n: int, zeros: list[int], ones: np.ndarray, block: Callable[[int, int], np.ndarray]):
        self.n, self.zeros, self.ones, self.block, self.levels = n, zeros, ones, block, len(zeros)

    @classmethod
    def build(cls, ids: np.ndarray, levels: int | None = None) -> WaveletMatrix:
        levels = levels or max(1, int(ids.max(initial=0)).bit_length())
        planes, zeros = [], []
        ids = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        for level in range(levels - 1, -1, -1):
            bits = (ids & ids.dtype.type(1 << level)).astype(bool)
            planes.append(np.packbits(bits, bitorder="little"))
            low = ids[~bits]
            zeros.append(len(low))
            ids = np.concatenate([low, ids[bits]])
        edges = np.arange(0, len(planes[0]), BLOCK_BYTES)
        ones = np.zeros((levels, len(edges) + 1), np.int64)
        for k, plane in enumerate(planes):
            if len(edges):
                ones[k, 1:] = np.cumsum(np.add.reduceat(np.bitwise_count(plane), edges, dtype=np.int64))
        return cls(len(ids), zeros, ones, lambda level, k: planes[level][k * BLOCK_BYTES : (k + 1) * BLOCK_BYTES])

    def _bit(self, level: int, i: int) -> int:
        return int(self.block(level, i // _BLOCK)[i % _BLOCK >> 3] >> (i & 7) & 1)

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        found, rest = int(self.ones[level, i // _BLOCK]), i % _BLOCK
        if not rest:
            return found
        block = self.block(level, i // _BLOCK)
        found += int(np.bitwise_count(block[: rest >> 3]).sum(dtype=np.int64))
        return found + int(block[rest >> 3] & ((1 << (rest & 7)) - 1)).bit_count() if rest & 7 else found

    def _place(self, level: int, bit: int, k: int) -> int:
        """Where the k-th (from 0) bit of this value is in a plane."""
        before = self.ones[level] if bit else np.arange(self.ones.shape[1]) * _BLOCK - self.ones[level]
        block = int(np.searchsorted(before, k, side="right")) - 1
        part = np.unpackbits(self.block(level, block), bitorder="little")
        return block * _BLOCK + int(np.flatnonzero(part == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        found = 0
        for level in range(self.levels):
            bit = self._bit(level, i)
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            found = found << 1 | bit
        return found

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """The places in the last order of those of the first i ids that are the token."""
        begin, end = 0, i
        if token >> self.levels:
            return 0, 0
        for level in range(self.levels):
            b, e = self._ones(level, begin), self._ones(level, end)
            if token >> (self.levels - 1 - level) & 1:
                begin, end = self.zeros[level] + b, self.zeros[level] + e
            else:
                begin, end = begin - b, end - e
        return begin, end

    def rank(self, token: int, i: int) -> int:
        """How often the token is among the first i ids."""
        begin, end = self._range(token, i)
        return end - begin

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Where the token occurs for the k-th time, from 0."""
        begin, end = self._range(token, self.n)
        if not 0 <= k < end - begin:
            raise IndexError(k)
        i = begin + k
        for level in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - level) & 1
            i = self._place(level, bit, i - self.zeros[level] if bit else i)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def plane(self, level: int) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint8), *(self.block(level, k) for k in range(self.ones.shape[1] - 1))])

    def decode(self) -> np.ndarray:
        kind = np.uint16 if self.levels <= 16 else np.uint32
        ids = np.zeros(self.n, kind)
        for level in range(self.levels - 1, -1, -1):
            bits = np.unpackbits(self.plane(level), count=self.n, bitorder="little").view(bool)
            back = np.empty(self.n, kind)
            back[~bits] = ids[: self.zeros[level]]
            back[bits] = ids[self.zeros[level] :] | kind(1 << (self.levels - 1 - level))
            ids = back
        return ids.astype(np.uint32)


def pack_shard(doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    """A shard file: magic, size of the head, the head, then the blocks of the planes, each compressed.

    The head, compressed too, has: numbers of ids, planes, blocks a plane and documents; size of the document ids;
    zeros of each plane; ones before and end of each block; ids a document; document ids (JSON).
    """
    matrix = WaveletMatrix.build(ids)
    pack = zstandard.ZstdCompressor(level=3).compress
    n_blocks = matrix.ones.shape[1] - 1
    blocks = [pack(matrix.block(level, k).tobytes()) for level in range(matrix.levels) for k in range(n_blocks)]
    names = json.dumps(doc_ids).encode()
    head = [struct.pack("<QIIIQ", matrix.n, matrix.levels, n_blocks, len(lengths), len(names))]
    head += [np.array(x, "<u8").tobytes() for x in (matrix.zeros, matrix.ones.ravel(), np.cumsum([0, *map(len, blocks)]), lengths)]
    packed = pack(b"".join([*head, names]))
    return b"".join([MAGIC, struct.pack("<I", len(packed)), packed, *blocks])


class Shard:
    """A shard file by its reader (place, size) -> bytes: the head is read at once, blocks as they are needed, a few held."""

    def __init__(self, read: Callable[[int, int], bytes]):
        first = read(0, 8)
        if first[:4] != MAGIC:
            raise ValueError("not a token shard")
        size = struct.unpack("<I", first[4:])[0]
        unpack = zstandard.ZstdDecompressor().decompress
        head = unpack(read(8, size))
        n, levels, n_blocks, docs, name_bytes = struct.unpack_from("<QIIIQ", head)
        at, parts = struct.calcsize("<QIIIQ"), []
        for k in (levels, levels * (n_blocks + 1), levels * n_blocks + 1, docs):
            parts.append(np.frombuffer(head, "<u8", k, at).astype(np.int64))
            at += 8 * k
        zeros, ones, ends, self.lengths = parts
        self.doc_ids: list = json.loads(head[at : at + name_bytes])
        self.blocks_read = 0

        @lru_cache(maxsize=64)
        def block(level: int, k: int) -> np.ndarray:
            self.blocks_read += 1
            at = level * n_blocks + k
            return np.frombuffer(unpack(read(8 + size + int(ends[at]), int(ends[at + 1] - ends[at]))), np.uint8)

        self.matrix = WaveletMatrix(n, zeros.tolist(), ones.reshape(levels, n_blocks + 1), block)


class CachedEncoder:
    """Ids of whole texts by a byte-level BPE of the tokenizers library, with a bounded cache.

    Such a tokenizer merges only within the pieces of its splitting pattern, and that pattern divides texts at
    some places whatever stands on either side of them (see units.byte_pair_edges): equal units between such places are
    encoded once. Texts with white space beyond ASCII, where that isn't so, or with the content of an added
    token, which is found before the pattern divides anything, are encoded as they are.
    """

    _odd = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._feed = self._encode(["\n"])[0]
        self.cache = UnitCache(self._encode_units, CACHE_UNITS)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units one after the other, and how many each has; units of words go as lines of one text, which the pattern divides at each end."""
        out: list[np.ndarray] = [None] * len(units)
        lines = [i for i, x in enumerate(units) if len(self._feed) == 1 and x[-1] not in b" \t\n\x0b\x0c\r"]
        for k in range(0, len(lines), 4096):
            part = lines[k : k + 4096]
            ids = self._encode([b"\n".join(units[i] for i in part).decode()])[0]
            cuts = np.flatnonzero(ids == self._feed[0])
            if len(cuts) == len(part) - 1:
                for i, b, e in zip(part, np.r_[0, cuts + 1].tolist(), np.r_[cuts, len(ids)].tolist()):
                    out[i] = ids[b:e]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self._encode([units[i].decode() for i in rest])):
            out[i] = ids
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)

    def _is_odd(self, text: str) -> bool:
        return any(x in text for x in self._added) or not text.isascii() and bool(self._odd.search(text)) or any(x in text for x in "\x1c\x1d\x1e\x1f")

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text in turn."""
        raw = encoded(texts)
        for part in chunks(raw):
            odd = [self._is_odd(x) for x in texts[part]]
            joined, starts = join([b"" if o else x for x, o in zip(raw[part], odd)])
            data = np.frombuffer(joined, np.uint8)
            ids, sizes = self.cache(joined, starts, byte_pair_edges(data, starts[:-1])) if len(data) else (np.zeros(0, np.uint32), np.zeros(len(odd), np.int64))
            ends = np.cumsum(sizes)
            for text, o, e, n in zip(texts[part], odd, ends.tolist(), sizes.tolist()):
                yield self._encode([text])[0] if o else ids[e - n : e]


@lru_cache(maxsize=2)
def shared_encoder(path: str) -> CachedEncoder:
    """One encoder, with its cache, for all tasks of a worker process."""
    return CachedEncoder(path)


def _put(uri: str, data: bytes) -> None:
    """Writes a file beside its place and moves it there, so that a task that runs again replaces it whole."""
    from pyarrow.fs import FileSystem, FileType

    fs, path = FileSystem.from_uri(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    aside = f"{os.path.dirname(path)}/_{os.path.basename(path)}.{TaskContext.get().taskAttemptId()}"
    with fs.open_output_stream(aside) as out:
        out.write(data)
    if fs.get_file_info(path).type != FileType.NotFound:
        fs.delete_file(path)  # of an attempt that got this far; not every store moves onto a file
    fs.move(aside, path)


def write_token_shards(docs: DataFrame, path: str, encoder: Callable[[], CachedEncoder], id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encodes every whole text, ends it with end_id and writes shards in ascending id order under path.

    Rows are dealt out by ranges of the id and sorted within them; each task writes the shards of its
    range, holding one shard of ids at a time. Null texts are empty (one end id); null ids come first;
    rows that share an id are ordered by length and hash of the text; other columns play no part. The
    manifest (range, shard, documents, ids) is a Parquet table beside the shards.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    ordered = docs.select(F.col(id_col).alias("id"), text.alias("text")).repartitionByRange("id").sortWithinPartitions("id", F.octet_length("text"), F.xxhash64("text"))
    numbers = isinstance(docs.schema[id_col].dataType, IntegralType)
    ordered = ordered.select(F.col("id").cast("string"), "text")  # pandas would make numbers beside a null floats

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, shard = TaskContext.get().partitionId(), 0
        names: list = []
        held: list[np.ndarray] = []
        size = 0
        coder = encoder()

        def close() -> pd.DataFrame:
            nonlocal shard, size
            _put(f"{path}/shards/{part:06d}-{shard:06d}.wvm", pack_shard(names, [len(x) for x in held], np.concatenate(held)))
            row = pd.DataFrame({"part": [part], "shard": [shard], "n_docs": [len(names)], "n_tokens": [size]})
            shard, size = shard + 1, 0
            names.clear()
            held.clear()
            return row

        for pdf in batches:
            for name, found in zip(pdf["id"], coder.encode(pdf["text"].tolist())):
                names.append(int(name) if numbers and name is not None else name)
                held.append(np.append(found, np.uint32(end_id)))
                size += len(found) + 1
                if size >= shard_tokens:
                    yield close()
        if names:
            yield close()

    ordered.mapInPandas(write, "part long, shard long, n_docs long, n_tokens long").write.parquet(f"{path}/manifest")


def read_token_shards(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the shards under path, from the files alone.

    A document's start is the ids of the ranges before its own, of the shards before its own and of the
    documents before it in its shard: sums of a row a range, then a row a shard.
    """
    manifest = spark.read.parquet(f"{path}/manifest")
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before_part = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before_part"))
    before = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")
    offsets = manifest.withColumn("before", before).join(before_part, "part").select(F.format_string("%06d-%06d.wvm", "part", "shard").alias("file"), (F.col("before") + F.col("before_part")).alias("offset"))
    text_ids = id_type == "string"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["file"], pdf["content"]):
                shard = Shard(lambda at, size, data=bytes(content): data[at : at + size])
                names, lengths, ids = shard.doc_ids, shard.lengths, shard.matrix.decode().astype("<u4")
                ends = np.cumsum(lengths)
                yield pd.DataFrame({
                    "file": name, "doc_id": pd.array(names, dtype="string" if text_ids else "Int64"), "begin": ends - lengths, "n_tokens": lengths,
                    "ids_crc32": [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends, lengths)],
                })

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wvm").load(f"{path}/shards") if offsets.take(1) else None
    if files is None:
        return spark.createDataFrame([], f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    found = named.mapInPandas(read, f"file string, doc_id {id_type}, begin long, n_tokens long, ids_crc32 long")
    return found.join(offsets, "file").select("doc_id", (F.col("offset") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def find_token(spark: SparkSession, path: str, token: int, id_type: str = "bigint") -> DataFrame:
    """(doc_id, place) of every occurrence of a token in the shards under path; place counts ids of the document from 0.

    Of each shard its head is read and, by rank and select, the blocks on the way to the occurrences; no shard is unpacked.
    """
    manifest = spark.read.parquet(f"{path}/manifest")
    text_ids = id_type == "string"

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        for pdf in batches:
            for name in pdf["file"]:
                fs, place = FileSystem.from_uri(f"{path}/shards/{name}")
                with fs.open_input_file(place) as file:
                    shard = Shard(lambda at, size, file=file: file.read_at(size, at))
                    at = np.array(shard.matrix.occurrences(token), np.int64)
                ends = np.cumsum(shard.lengths)
                doc = np.searchsorted(ends, at, side="right")
                yield pd.DataFrame({"doc_id": pd.array([shard.doc_ids[k] for k in doc], dtype="string" if text_ids else "Int64"), "place": at - (ends - shard.lengths)[doc]})

    return manifest.select(F.format_string("%06d-%06d.wvm", "part", "shard").alias("file")).mapInPandas(find, f"doc_id {id_type}, place long")
