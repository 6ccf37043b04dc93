"""Token ids in sorted-string-table shards.

Documents are range-partitioned and sorted by id, encoded, and written as one file a partition:

    data blocks   entries in key order: varint shared key bytes, varint other key bytes, varint value bytes, key rest, value
    index         for each block: first key, offset, bytes, tokens before it (the sparse index)
    Bloom filter  of the keys
    footer        64 bytes: magic, id bytes, hashes, documents, tokens, offsets and lengths of index and filter

Each of these is one record followed by a line feed, as Spark's text writer puts it; so files are committed by Spark's own
protocol and may lie in any store. Keys are 9 bytes that sort like (null first, id). Ids take two bytes
where the vocabulary allows, else four. Spark's binaryFile source reads the shards back.

A small side table, a row a shard, repeats what a lookup needs of each: first and last key, Bloom filter, index. A lookup prunes shards
there, finds the blocks by binary search, and reads the bytes of these blocks only.

Defined results: null or empty text has only the end id; a null id is a key of its own and sorts first; repeated ids are entries of their own, side by
side, and may be cut between shards; an empty table writes no shard and reads back empty; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fusegrid.llm.common import shuffle_partitions, slices, work_dir

MAGIC = b"FGSST1\r\n"
BLOCK_BYTES = 64 << 10
SHARD_BYTES = 24 << 20
BLOOM_BITS, BLOOM_HASHES = 10, 7
END_ID = 0
#: Characters of texts encoded at a time, and different chunks given to the library in one text.
ENCODE_CHARS = 8 << 20
CHUNKS_PER_TEXT = 2000
#: Chunks up to this length are remembered; about so many of them by each worker.
KEPT_CHARS, KEPT_CHUNKS = 8, 300_000
#: Texts whose ids are put together at a time.
GATHER_TEXTS = 256
_FOOTER = struct.Struct("<8sBBxxIQQQIQIxxxx")
_INDEX = struct.Struct("<9sQIQ")
_STATE: dict = {}


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", doc_id + 2**63)


def id_of(key: bytes) -> int | None:
    return None if key[:1] == b"\0" else struct.unpack(">Q", key[1:])[0] - 2**63


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def _bloom_places(key: bytes, bits: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + k * (b | 1)) % bits for k in range(BLOOM_HASHES)]


class _Encoder:
    """The tokenizers library, asked once for each different chunk between single spaces of a batch.

    Byte-level pre-tokenisation always cuts before a space that has no white space on either side, so the chunks' ids joined are the text's.
    Different chunks are given to the library many to a text; only a chunk's first token begins with the space, so its ids are cut there.
    """

    def __init__(self, path: str, width: int):
        import os

        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib, self.kind = Tokenizer.from_file(path), np.dtype("<u2" if width == 2 else "<u4")
        self.memo: dict[str, bytes] = {}
        made = json.loads(self.lib.to_str())
        self.special = [t["content"] for t in made["added_tokens"]]
        pre = made.get("pre_tokenizer") or {}
        self.chunked = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not made.get("normalizer") and not any(" " in s for s in self.special)
        self.odd = re.compile(r"\s\s")
        vocab = self.lib.get_vocab()
        self.begins = np.zeros(max(vocab.values()) + 1, bool)
        self.begins[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True  # how byte-level vocabularies write a space

    def library(self, texts: list[str]) -> list:
        import numpy as np

        return [np.array(e.ids, self.kind) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def chunk_ids(self, chunks: list[str]) -> tuple:
        """Ids of all these different chunks, each after a space, in one array, and how many each has."""
        import numpy as np

        memo, wide = self.memo, self.kind.itemsize
        if len(memo) > KEPT_CHUNKS:
            memo.clear()
        got = list(map(memo.get, chunks))
        new = [k for k, v in enumerate(got) if v is None]
        for at in range(0, len(new), CHUNKS_PER_TEXT):
            some = new[at : at + CHUNKS_PER_TEXT]
            (ids,) = self.library([" " + " ".join([chunks[k] for k in some])])
            start = np.flatnonzero(self.begins[ids])
            if len(start) != len(some):
                raise ValueError("a chunk's first token, and no other, must begin with a space")
            cut, data = (np.append(start, len(ids)) * wide).tolist(), ids.tobytes()
            for k, x, y in zip(some, cut, cut[1:], strict=False):
                got[k] = v = data[x:y]
                if len(chunks[k]) <= KEPT_CHARS:
                    memo[chunks[k]] = v
        return np.frombuffer(b"".join(got), self.kind), np.fromiter(map(len, got), np.int64, len(got)) // wide

    def encode(self, texts: list[str]) -> list[bytes]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        plain = [i for i, t in enumerate(texts) if t and self.chunked and not (t[0].isspace() or t[-1].isspace() or self.odd.search(t)) and not any(s in t for s in self.special)]
        out = [b""] * len(texts)
        rest = [i for i in {*range(len(texts))}.difference(plain) if texts[i]]
        for i, ids in zip(rest, self.library([texts[i] for i in rest]), strict=True):
            out[i] = ids.tobytes()
        if not plain:
            return out
        cut = pc.split_pattern(pa.array([texts[i] for i in plain], pa.string()), " ")
        ends = cut.offsets.to_numpy()
        coded = cut.flatten().dictionary_encode()
        code, first = coded.indices.to_numpy(), ends[:-1]
        firsts = self.library(coded.take(pa.array(first)).to_pylist())  # these have no space before them
        chunks = coded.dictionary.to_pylist()
        del cut, coded  # so that memory holds less while the library works
        flat, size = self.chunk_ids(chunks)
        begin = np.append(0, np.cumsum(size))[:-1]
        for at in range(0, len(plain), GATHER_TEXTS):
            some = ends[at : at + GATHER_TEXTS + 1] - ends[at]
            mine = code[ends[at] : ends[at] + some[-1]]
            n = size[mine]
            n[some[:-1]] = 0  # the first chunks
            upto = np.append(0, np.cumsum(n))
            ids = flat[np.repeat(begin[mine] - upto[:-1], n) + np.arange(upto[-1])]
            for k, (x, y) in enumerate(zip(upto[some[:-1]], upto[some[1:]], strict=True)):
                out[plain[at + k]] = firsts[at + k].tobytes() + ids[x:y].tobytes()
        return out


def _encoder(path: str, width: int) -> _Encoder:
    if _STATE.get("of") != (path, width):
        _STATE.update(of=(path, width), encoder=_Encoder(path, width))
    return _STATE["encoder"]


def _data_block(entries: list[tuple[bytes, bytes]]) -> bytes:
    out, before = bytearray(), b""
    for key, value in entries:
        shared = 0
        while shared < len(before) and before[shared] == key[shared]:
            shared += 1
        out += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        before = key
    return bytes(out)


def _block_entries(block) -> Iterator[tuple[bytes, memoryview]]:
    at, key = 0, b""
    while at < len(block):
        shared, at = _read_varint(block, at)
        rest, at = _read_varint(block, at)
        size, at = _read_varint(block, at)
        key = key[:shared] + bytes(block[at : at + rest])
        at += rest
        yield key, block[at : at + size]
        at += size


def shard_records(entries: Iterator[tuple[bytes, bytes]], width: int) -> Iterator[bytes]:
    """The records of one shard, from entries in key order."""
    keys, index, block, size, offset, tokens, before = [], [], [], 0, 0, 0, 0

    def close() -> bytes:
        nonlocal block, size, offset, before
        data = _data_block(block)
        index.append(_INDEX.pack(block[0][0], offset, len(data), before))
        offset += len(data) + 1
        block, size, before = [], 0, tokens
        return data

    for key, value in entries:
        block.append((key, value))
        keys.append(key)
        size += len(value)
        tokens += len(value) // width
        if size >= BLOCK_BYTES:
            yield close()
    if block:
        yield close()
    if not keys:
        return
    table = b"".join(index)
    yield table
    at_index, offset = offset, offset + len(table) + 1
    bits = max(64, BLOOM_BITS * len(keys))
    bloom = bytearray(-(-bits // 8))
    for key in keys:
        for p in _bloom_places(key, bits):
            bloom[p >> 3] |= 1 << (p & 7)
    yield bytes(bloom)
    yield _FOOTER.pack(MAGIC, width, BLOOM_HASHES, len(index), len(keys), tokens, at_index, len(table), offset, len(bloom))


class Shard:
    """One file's bytes."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        foot = self.data[len(data) - _FOOTER.size - 1 : len(data) - 1]
        magic, self.width, _, _, self.docs, self.tokens, at, size, self.bloom_at, self.bloom_size = _FOOTER.unpack(foot)
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.index = read_index(self.data[at : at + size])

    def first_key(self) -> bytes:
        return self.index[0][0]

    def last_key(self) -> bytes:
        _, offset, size, _ = self.index[-1]
        return max(key for key, _ in _block_entries(self.data[offset : offset + size]))

    def index_bytes(self) -> bytes:
        return b"".join(_INDEX.pack(*x) for x in self.index)

    def bloom(self) -> bytes:
        return bytes(self.data[self.bloom_at : self.bloom_at + self.bloom_size])

    def may_hold(self, key: bytes) -> bool:
        return may_hold(self.bloom(), self.docs, key)

    def entries(self, first_block: int = 0) -> Iterator[tuple[bytes, int, memoryview]]:
        """Key, tokens before it in this shard, value."""
        for _, offset, size, before in self.index[first_block:]:
            for key, value in _block_entries(self.data[offset : offset + size]):
                yield key, before, value
                before += len(value) // self.width

    def find(self, key: bytes) -> list[memoryview]:
        """Bloom filter, binary search of the sparse index, then the blocks."""
        blocks = blocks_of(self.index, key) if self.may_hold(key) else []
        return [v for offset, size in blocks for k, v in _block_entries(self.data[offset : offset + size]) if k == key]


def may_hold(bloom: bytes, docs: int, key: bytes) -> bool:
    bits = max(64, BLOOM_BITS * docs)
    return all(bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, bits))


def read_index(data: bytes) -> list[tuple]:
    return list(_INDEX.iter_unpack(data))


def blocks_of(index: list[tuple], key: bytes) -> list[tuple[int, int]]:
    """Offset and bytes of the blocks that may hold a key: the last that begins below it, and all that begin with it."""
    firsts = [x[0] for x in index]
    return [x[1:3] for x in index[max(0, bisect.bisect_left(firsts, key) - 1) : bisect.bisect_right(firsts, key)]]


def write_store(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append the end id, and write shards in ascending id order, and the side table."""
    import json as j

    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        vocab = len(j.load(f)["model"]["vocab"])
    width = 2 if vocab + 256 <= 1 << 16 else 4
    end = struct.pack("<H" if width == 2 else "<I", END_ID)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(shuffle_partitions(spark), -(-total // SHARD_BYTES))

    def build(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = _encoder(tokenizer, width)

        def entries():
            ids, texts, size = [], [], 0
            for batch in slices(batches):
                for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    ids.append(i)
                    texts.append(t)
                    size += len(t)
                    if size >= ENCODE_CHARS:
                        yield from zip(map(key_of, ids), encoder.encode(texts), strict=True)
                        ids, texts, size = [], [], 0
            yield from zip(map(key_of, ids), encoder.encode(texts), strict=True)

        for record in shard_records(((k, v + end) for k, v in entries()), width):
            yield pa.RecordBatch.from_arrays([pa.array([record], pa.binary())], ["value"])

    # with the row's number, many rows of one id can be cut between shards
    sorted_docs = base.repartitionByRange(shards, "doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "text")
    # as a string the bytes are left as they are
    sorted_docs.mapInArrow(build, "value binary").select(F.col("value").cast("string").alias("value")).write.text(_shards(path))
    _heads(spark, path).write.parquet(_side(path))


def _shards(path: str) -> str:
    return f"{path.rstrip('/')}/shards"


def _side(path: str) -> str:
    return f"{path.rstrip('/')}/side"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(_shards(path)).where("length > 0").select("path", "content")


def _heads(spark: SparkSession, path: str) -> DataFrame:
    """A row a shard: path, width, documents, tokens, first and last key, Bloom filter, index."""

    def heads(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches, 1):
            own = Shard(batch.column("content")[0].as_py())
            cols = [own.width, own.docs, own.tokens, own.first_key(), own.last_key(), own.bloom(), own.index_bytes()]
            kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([batch.column("path"), *[pa.array([c], k) for c, k in zip(cols, kinds, strict=True)]], ["path", *_HEAD_NAMES])

    return _files(spark, path).mapInArrow(heads, _HEADS)


_HEADS = "path string, width int, docs long, tokens long, first_key binary, last_key binary, bloom binary, index binary"
_HEAD_NAMES = [x.split()[0] for x in _HEADS.split(", ")][1:]


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit)."""

    def documents(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        names = ["path", "doc_id", "local", "n_tokens", "ids"]
        for batch in slices(batches, 1):
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                shard = Shard(data)
                kind = np.dtype("<u2" if shard.width == 2 else "<u4")
                rows = []
                for key, before, value in shard.entries():
                    rows.append((id_of(key), before, len(value) // shard.width, np.frombuffer(value, kind).astype("<u4").tobytes()))
                    if len(rows) == 512:
                        yield _rows(pa, name, rows, names)
                        rows = []
                if rows:
                    yield _rows(pa, name, rows, names)

    heads = spark.read.schema(_HEADS).parquet(_side(path))
    # a row a shard; shards that hold parts of one id's rows in the order of their last keys
    order = Window.orderBy("first_key", "last_key", "path")
    offsets = heads.select("path", (F.sum("tokens").over(order) - F.col("tokens")).alias("offset"))
    body = _files(spark, path).mapInArrow(documents, "path string, doc_id long, local long, n_tokens long, ids binary")
    return body.join(F.broadcast(offsets), "path").select("doc_id", (F.col("offset") + F.col("local")).alias("start"), "n_tokens", "ids")


def _rows(pa, name, rows, names):
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    cols = [[name] * len(rows), *map(list, zip(*rows, strict=True))]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def lookup(spark: SparkSession, path: str, ids: list[int | None]) -> DataFrame:
    """doc_id, n_tokens, ids of the given few documents: shards by side table and Bloom filter, blocks by binary search, then the bytes of these."""
    import numpy as np

    keys = sorted({key_of(i) for i in ids})

    def find(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            out = []
            for name, width, docs, low, high, bloom, index in zip(*(batch.column(c).to_pylist() for c in ("path", "width", "docs", "first_key", "last_key", "bloom", "index")), strict=True):
                some = [k for k in keys[bisect.bisect_left(keys, low) : bisect.bisect_right(keys, high)] if may_hold(bloom, docs, k)]
                if some:
                    blocks = read_index(index)
                    out += [(name, width, k, offset, size) for k in some for offset, size in blocks_of(blocks, k)]
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.int64()], strict=True)], ["path", "width", "key", "offset", "size"])

    side = spark.read.schema(_HEADS).parquet(_side(path))
    rows = []
    for r in side.mapInArrow(find, "path string, width int, key binary, offset long, size long").collect():  # the blocks of the few ids asked
        kind, wanted = np.dtype("<u2" if r["width"] == 2 else "<u4"), bytes(r["key"])
        for key, value in _block_entries(read_bytes(spark, r["path"], r["offset"], r["size"])):
            if key == wanted:
                rows.append((id_of(key), len(value) // kind.itemsize, bytearray(np.frombuffer(value, kind).astype("<u4").tobytes())))
    return spark.createDataFrame(rows, "doc_id long, n_tokens long, ids binary")


def read_bytes(spark: SparkSession, path: str, offset: int, size: int) -> bytes:
    """A range of a file in any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    file = jvm.org.apache.hadoop.fs.Path(path)
    stream = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(file)
    try:
        stream.seek(offset)
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size))
    finally:
        stream.close()


def store_round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write a store in the shared folder and read it back."""
    path = f"{work_dir(docs.sparkSession)}/store"
    write_store(docs, path, tokenizer)
    return read_store(docs.sparkSession, path)
