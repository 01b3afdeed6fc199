"""Token-id files with a minimal perfect hash index (operator 1).

``write_token_files`` sorts documents by key, encodes whole texts and writes one pair of files a
shard: ``.ids`` holds nothing but raw little-endian ids, ``.mph`` the index.  The index maps a key
to its rows through a minimal perfect hash: levels of bit arrays, where a key's place is the rank of
its first uncontested bit.  A fingerprint stored at that place tells absent keys from present ones,
and row offsets lead to the ids, so that a lookup reads a constant number of entries.

Defined results: a null text is the empty text (its ids are the end id alone); a null key sorts
first and is kept apart from the hash; rows that share a key follow each other, ordered by text, and
a lookup returns all of them; a key with very many rows may span shards, as may equal rows; an empty
table gives no files.  Other columns of the input are not touched.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import store, words

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SHARD = "shard int, ids_file string, index_file string, n_rows long, n_ids long, null_rows long, low long, high long"


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over keys and a seed."""
    x = keys.astype(np.uint64) + np.uint64(((seed + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Distinct 64-bit keys to 0..n-1, by levels of bit arrays with ranks."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels, self.ranks, before = levels, [], 0
        for bits in levels:
            ones = np.cumsum(np.bitwise_count(bits), dtype=np.int64)
            self.ranks.append(before + np.concatenate(([0], ones[:-1])))
            before += int(ones[-1]) if len(ones) else 0

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, levels = np.unique(keys.astype(np.uint64)), []
        while len(left):
            size = 64 * (2 * len(left) // 64 + 1)
            at = (mixed(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        return cls(levels)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where no level knows it. Absent keys may get a place too: see the fingerprints."""
        keys = keys.astype(np.uint64)
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = (mixed(keys[left], k) % np.uint64(64 * len(bits))).astype(np.int64)
            word, shift = bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> shift) & np.uint64(1) == 1
            below = word & ((np.uint64(1) << shift) - np.uint64(1))
            out[left[hit]] = ranks[at[hit] >> 6] + np.bitwise_count(below[hit])
            left = left[~hit]
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 4093) >> np.uint64(32)).astype(np.uint32)


class ShardIndex:
    """Row offsets of a shard and the way from a key to its rows."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays
        self.hash = PerfectHash([arrays[f"level{k}"] for k in range(int(arrays["n_levels"][0]))])

    @classmethod
    def build(cls, keys: np.ndarray, null_rows: int, offsets: np.ndarray) -> ShardIndex:
        """keys: of the rows after the null ones, ascending. offsets: of all rows, with the end."""
        distinct, first, count = np.unique(keys, return_index=True, return_counts=True)
        made = PerfectHash.build(distinct)
        place = made(distinct)
        arrays = {"offsets": offsets.astype("<i8"), "null_rows": np.array([null_rows]), "n_levels": np.array([len(made.levels)])}
        for name, values, kind in (("fingerprints", fingerprint(distinct), "<u4"), ("first", first + null_rows, "<i8"), ("count", count, "<i8"), ("keys", distinct, "<i8")):
            slot = np.zeros(len(distinct), kind)
            slot[place] = values
            arrays[name] = slot
        levels = {f"level{k}": bits for k, bits in enumerate(made.levels)} | {f"rank{k}": ranks.astype("<i8") for k, ranks in enumerate(made.ranks)}
        return cls(arrays | levels)

    def rows(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows of each key; the number is 0 for a key that isn't there."""
        at = self.hash(keys)
        at, known = np.maximum(at, 0), at >= 0
        if not len(self.arrays["keys"]):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        known &= (self.arrays["fingerprints"][at] == fingerprint(keys)) & (self.arrays["keys"][at] == keys)
        return self.arrays["first"][at], np.where(known, self.arrays["count"][at], 0)

    def dump(self) -> bytes:
        head = json.dumps([[k, v.dtype.str, len(v)] for k, v in self.arrays.items()]).encode()
        return len(head).to_bytes(8, "little") + head + b"".join(v.tobytes() for v in self.arrays.values())

    @classmethod
    def load(cls, data: bytes) -> ShardIndex:
        size, arrays = int.from_bytes(data[:8], "little"), {}
        at = 8 + size
        for name, kind, n in json.loads(data[8:at]):
            arrays[name] = np.frombuffer(data, kind, n, at)
            at += arrays[name].nbytes
        return cls(arrays)


class StoredIndex:
    """An index file looked into by seeking: for each key a bit word and its rank on some levels, then one slot."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.arrays = file, {}
        size = int.from_bytes(file.read(8), "little")
        at = 8 + size
        for name, kind, n in json.loads(file.read(size)):
            self.arrays[name] = (at, np.dtype(kind), n)
            at += np.dtype(kind).itemsize * n
        self.n_levels = int(self.read("n_levels", 0)[0])

    def read(self, name: str, row: int, rows: int = 1) -> np.ndarray:
        at, kind, _ = self.arrays[name]
        self.file.seek(at + row * kind.itemsize)
        return np.frombuffer(self.file.read(rows * kind.itemsize), kind)

    def rows(self, key: int) -> tuple[int, int]:
        """First row and number of rows of a key; the number is 0 for a key that isn't there."""
        own = np.array([key], np.int64)
        for k in range(self.n_levels):
            at = int(mixed(own, k)[0] % np.uint64(64 * self.arrays[f"level{k}"][2]))
            word, bit = int(self.read(f"level{k}", at >> 6)[0]), at & 63
            if word >> bit & 1:
                place = int(self.read(f"rank{k}", at >> 6)[0]) + (word & ((1 << bit) - 1)).bit_count()
                if self.read("fingerprints", place)[0] != fingerprint(own)[0] or self.read("keys", place)[0] != key:
                    return 0, 0
                return int(self.read("first", place)[0]), int(self.read("count", place)[0])
        return 0, 0


class ChunkEncoder:
    """Distinct chunks to bytes of 32-bit ids, by the tokenizers library, which sees each part once.

    Punctuation after a letter is encoded apart: the splitter separates the two in any case.  A file
    whose normaliser and splitter don't work this way (``by_chunk`` is false) encodes whole texts.
    """

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(tokenizer_file, encoding="utf-8") as f:
            self.by_chunk = words.cuts_chunks(json.load(f))
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.parts = words.Remembered(self._library, 600_000)

    def _library(self, new: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]

    def __call__(self, distinct: pa.Array) -> list[bytes]:
        halves = []
        for half in words.apart(distinct):
            coded = half.dictionary_encode()
            got = self.parts(coded.dictionary.to_pylist())
            halves.append([got[k] for k in coded.indices.to_pylist()])
        return [a + b for a, b in zip(*halves, strict=True)]

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin. Null is the empty text."""
        if self.by_chunk:
            codes, offsets, distinct = words.coded_chunks(texts)
            return words.gather(self(distinct), codes, offsets)
        own = self._library(["" if t is None else t for t in texts.to_pylist()])
        return words.gather(own, np.arange(len(own)), np.arange(len(own) + 1))


def chunk_encoder(tokenizer_file: str) -> ChunkEncoder:
    """One encoder a worker process, so that later tasks know what earlier ones have seen."""
    encoders = words.kept("token_files")
    if tokenizer_file not in encoders:
        encoders[tokenizer_file] = ChunkEncoder(tokenizer_file)
    return encoders[tokenizer_file]


def write_token_files(docs: DataFrame, tokenizer_file: str, end_id: int, key: str = "doc_id", text: str = "text", id_type: str = "<u2") -> DataFrame:
    """Encode and write all documents in ascending key order; returns the table of shards (already written).

    ``id_type`` is the width of an id in the files: ``<u2`` where the vocabulary has fewer than
    65,536 ids, else ``<u4``.  A task that is run again writes files of other names; the table names
    those of the attempt that Spark committed.
    """
    folder = store.workers_folder(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = store.filesystem(folder)
        filesystem.create_dir(base, recursive=True)
        shard, encode = TaskContext.get().partitionId(), chunk_encoder(tokenizer_file)
        name = f"{base}/{shard:06d}-{uuid.uuid4().hex}"
        keys, null_rows, lengths, out = [], 0, [], None
        for batch in words.slices(batches, "text"):
            flat, begins = encode.texts(batch["text"])
            if len(flat) and flat.max() > np.iinfo(id_type).max:
                raise ValueError(f"an id does not fit {id_type}")
            ids = np.insert(flat, begins[1:], end_id).astype(id_type)
            out = out or filesystem.open_output_stream(f"{name}.ids")
            out.write(ids.tobytes())
            lengths.append(np.diff(begins) + 1)
            null_rows += batch["key"].null_count
            keys.append(np.asarray(batch["key"].drop_null(), dtype=np.int64))
        if out is None:
            return
        out.close()
        keys, ends = np.concatenate(keys), np.concatenate(([0], np.cumsum(np.concatenate(lengths))))
        with filesystem.open_output_stream(f"{name}.mph") as index:
            index.write(ShardIndex.build(keys, null_rows, ends).dump())
        row = [[shard], [f"{name}.ids"], [f"{name}.mph"], [len(ends) - 1], [int(ends[-1])], [null_rows], [int(keys[0]) if len(keys) else None], [int(keys[-1]) if len(keys) else None]]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 5), strict=True)], ["shard", "ids_file", "index_file", "n_rows", "n_ids", "null_rows", "low", "high"])

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).withColumn("salt", F.xxhash64("text"))
    ranged = rows.repartitionByRange("key", "salt").sortWithinPartitions("key", "salt", "text").select("key", "text")
    shards = store.keep(ranged.mapInArrow(write, _SHARD))
    shards._folder = folder
    return shards


def _open(filesystem: pafs.FileSystem, ids_file: str, index_file: str) -> tuple[ShardIndex, pa.NativeFile]:
    with filesystem.open_input_stream(index_file) as f:
        index = ShardIndex.load(f.read())
    return index, filesystem.open_input_file(ids_file)


def _located(shards: DataFrame) -> tuple[str, list]:
    """Shards in key order with the number of ids before each: one row a shard, as many as Spark has partitions."""
    rows, before, out = sorted(shards.collect(), key=lambda r: r.shard), 0, []
    for r in rows:
        out.append((*r, before))
        before += r.n_ids
    return out


def read_token_files(shards: DataFrame, id_type: str = "<u2", width: int = 1 << 20) -> DataFrame:
    """Every document from the files: key, start, n_tokens, ids_crc32. Each key is looked up in its shard's index.

    A null key takes the shard's null rows.  Ids are read ``width`` at a time at least one document.
    """
    spark, located = shards.sparkSession, _located(shards)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not located:
        return spark.createDataFrame([], schema)
    folder = shards._folder

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, _ = store.filesystem(folder)
        for batch in batches:
            for r in batch.to_pylist():
                index, ids = _open(filesystem, r["ids_file"], r["index_file"])
                listed = np.sort(index.arrays["keys"])
                first, count = index.rows(listed)
                if (count == 0).any() or count.sum() + r["null_rows"] != r["n_rows"]:
                    raise ValueError(f"the index of {r['ids_file']} does not cover its rows")
                places = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
                places = np.concatenate((np.arange(r["null_rows"]), places))
                keys = pa.array(np.concatenate((np.zeros(r["null_rows"], np.int64), np.repeat(listed, count))), mask=np.arange(len(places)) < r["null_rows"])
                starts, ends = index.arrays["offsets"][places], index.arrays["offsets"][places + 1]
                at, sums, size = 0, [], np.dtype(id_type).itemsize
                while at < len(places):
                    stop = max(at + 1, int(np.searchsorted(ends, starts[at] + width, side="right")))
                    ids.seek(int(starts[at]) * size)
                    block = np.frombuffer(ids.read(int(ends[stop - 1] - starts[at]) * size), id_type).astype("<u4")
                    sums += [zlib.crc32(block[s:e]) for s, e in zip(starts[at:stop] - starts[at], ends[at:stop] - starts[at], strict=True)]
                    at = stop
                yield pa.RecordBatch.from_arrays([keys, pa.array(starts + r["before"]), pa.array(ends - starts), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame(located, _SHARD + ", before long").repartition(len(located))
    return listed.mapInArrow(read, schema)


def lookup_token_files(shards: DataFrame, keys: DataFrame, key: str = "doc_id", id_type: str = "<u2") -> DataFrame:
    """The ids of each asked key, one row a stored document: constant work a key, none for keys that aren't stored.

    Null keys are not looked up.  Only the list of shards travels to the tasks.
    """
    located, folder = [r for r in _located(shards) if r[6] is not None], shards._folder
    lows, highs = np.array([r[6] for r in located], np.int64), np.array([r[7] for r in located], np.int64)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, _ = store.filesystem(folder)
        for batch in batches:
            asked = np.asarray(batch["key"].drop_null(), dtype=np.int64)
            for k in np.flatnonzero((lows <= asked.max()) & (highs >= asked.min())) if len(asked) else ():
                own = asked[(asked >= lows[k]) & (asked <= highs[k])]
                if not len(own):
                    continue
                index, ids = StoredIndex(filesystem.open_input_file(located[k][2])), filesystem.open_input_file(located[k][1])
                for x in own.tolist():
                    first, count = index.rows(x)
                    for row in range(first, first + count):
                        a, b = (int(v) for v in index.read("offsets", row, 2))
                        ids.seek(a * np.dtype(id_type).itemsize)
                        got = np.frombuffer(ids.read((b - a) * np.dtype(id_type).itemsize), id_type).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()), pa.array([got.tolist()], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return keys.select(F.col(f"`{key}`").cast("long").alias("key")).mapInArrow(find, "doc_id long, ids array<long>")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, written and read back; end id 1."""
    import public_tokenizers

    shards = write_token_files(store.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_token_files(shards)
