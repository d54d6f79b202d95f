"""Token ids in fixed-width bit packing.

A store is a folder of Parquet files, a row a block. A block holds the ids of whole documents, in the order
of the store, packed at the least width that the vocabulary needs: id k of a block takes the bits from
k * width on, least significant bits first, padded to a whole 64-bit word at the end. The row also has the
block's shard and number, where its ids begin in the shard, and its documents with the offsets of their ids,
so that a document is found by arithmetic and unpacked by numpy in one step, without the ids before it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinia.llm.common import wide_rows
from affinia.llm.encode import Encoder, encoder

#: Written before the packed ids of a block: format and version.
MAGIC = b"FWBP0001"
SCHEMA = "shard int, block int, start long, n_ids long, width int, doc_ids array<long>, offsets array<long>, payload binary"


def width_for(vocabulary: int) -> int:
    """Least bits for ids 0 to vocabulary - 1."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Pack ids at a width of 1 to 32 bits into little-endian 64-bit words."""
    ids = np.asarray(ids)
    if len(ids) and int(ids.max()) >> width:
        raise ValueError("an id needs more bits than the width")
    if width in (8, 16, 32):
        raw = ids.astype(f"<u{width // 8}").tobytes()
        return raw + bytes(-len(raw) % 8)
    ids = ids.astype(np.uint64)
    bit = np.arange(len(ids), dtype=np.uint64) * np.uint64(width)
    word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
    out = np.zeros((len(ids) * width + 63) // 64 + 1, np.uint64)
    np.bitwise_or.at(out, word, ids << shift)
    over = shift + np.uint64(width) > 64
    np.bitwise_or.at(out, word[over] + 1, ids[over] >> (np.uint64(64) - shift[over]))
    return out[:-1].astype("<u8").tobytes()


def unpack(payload: bytes, width: int, first: int, n: int) -> np.ndarray:
    """Ids first to first + n - 1 of a payload, as unsigned 32-bit integers, without reading others."""
    if not n:
        return np.zeros(0, np.uint32)
    if width in (8, 16, 32):
        return np.frombuffer(payload, f"<u{width // 8}", n, first * width // 8).astype(np.uint32)
    begin = first * width // 64
    words = np.frombuffer(payload, "<u8", ((first + n) * width + 63) // 64 - begin, begin * 8)
    words = np.append(words, np.uint64(0)).astype(np.uint64)
    bit = (np.arange(first, first + n, dtype=np.uint64) * np.uint64(width)) - np.uint64(begin * 64)
    word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    return ((low | high) & np.uint64((1 << width) - 1)).astype(np.uint32)


def write_store(
    docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, shards: int | None = None, block_ids: int = 1 << 16
) -> int:
    """Encode docs (doc_id, text), append end_id to each, and write a store to path; returns the id width.

    Documents stand in ascending order of doc_id over the shards, and so do shards; nulls come first, and
    rows of one doc_id stand in the order of the table, so that they may be dealt to several shards. A block
    closes at ``block_ids`` ids; it always holds whole documents. A null text is an empty one. Equal rows are
    stored each. Other columns are ignored. An empty table gives a store without blocks.
    """
    width = width_for(max(Encoder(tokenizer).vocabulary, (end_id or 0) + 1))
    chosen = wide_rows(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("rid"))
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tail = np.asarray([] if end_id is None else [end_id], "<u4")

    def rows(it) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        coder = encoder(tokenizer)
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        doc_ids: list = []
        parts: list[np.ndarray] = []
        offsets = [0]

        def closed() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            row = (shard, block, start, len(ids), width, doc_ids, offsets, MAGIC + pack(ids, width))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], names=names)

        for batch in it:
            coded = coder.encode_many(batch.column(1).to_pylist())
            for doc_id, ids in zip(batch.column(0), coded, strict=True):
                doc_ids.append(doc_id.as_py())
                parts += [ids, tail]
                offsets.append(offsets[-1] + len(ids) + len(tail))
                if offsets[-1] >= block_ids:
                    yield closed()
                    block, start, doc_ids, parts, offsets = block + 1, start + offsets[-1], [], [], [0]
        if doc_ids:
            yield closed()

    dealt = chosen.repartitionByRange(shards, "doc_id", "rid").sortWithinPartitions("doc_id", "rid")
    dealt.mapInArrow(rows, SCHEMA).write.parquet(path)
    return width


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def read_store(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document of a store.

    start counts the ids of all documents before it in the store; ids_crc32 is that of its ids as
    little-endian unsigned 32-bit integers. Blocks are unpacked independently.
    """
    blocks = read_blocks(spark, path)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("shard").alias("b_shard"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = blocks.join(F.broadcast(bases), F.col("shard") == F.col("b_shard"))  # a row for each shard
    placed = placed.select((F.col("base") + F.col("start")).alias("start"), "width", "doc_ids", "offsets", "payload")

    def rows(it) -> Iterator:
        import pyarrow as pa

        for batch in it:
            for start, width, doc_ids, offsets, payload in zip(*batch.columns, strict=True):
                start, width, offsets = start.as_py(), width.as_py(), np.asarray(offsets.as_py())
                raw = payload.as_buffer().to_pybytes()
                if raw[: len(MAGIC)] != MAGIC:
                    raise ValueError("not a block of this format")
                ids = unpack(raw[len(MAGIC) :], width, 0, int(offsets[-1]))
                own = [ids[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
                cols = [
                    pa.array(doc_ids.as_py(), pa.int64()),
                    pa.array(start + offsets[:-1], pa.int64()),
                    pa.array(np.diff(offsets), pa.int64()),
                    pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64()),
                ]
                if with_ids:
                    cols.append(pa.array([x.tolist() for x in own], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    return placed.mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def read_slice(spark: SparkSession, path: str, shard: int, first: int, n: int) -> np.ndarray:
    """Random access: n ids of a shard from its id ``first`` on; only blocks that hold them are read."""
    blocks = read_blocks(spark, path).filter((F.col("shard") == shard) & (F.col("start") < first + n) & (F.col("start") + F.col("n_ids") > first))
    out = [np.zeros(0, np.uint32)]
    for b in blocks.orderBy("block").select("start", "n_ids", "width", "payload").toLocalIterator():
        a, z = max(first, b.start), min(first + n, b.start + b.n_ids)
        out.append(unpack(bytes(b.payload)[len(MAGIC) :], b.width, a - b.start, z - a))
    return np.concatenate(out)


def read_document(spark: SparkSession, path: str, doc_id: int | None) -> list[np.ndarray]:
    """Random access by id: the ids of each document of that doc_id, in the order of the store. Only blocks
    whose ids span doc_id are read, and of these only its documents are unpacked."""
    blocks = read_blocks(spark, path)
    first, last = F.element_at("doc_ids", 1), F.element_at("doc_ids", -1)  # ascending, nulls first
    wanted = first.isNull() if doc_id is None else (first.isNull() | (first <= doc_id)) & (last >= doc_id)
    out = []
    for b in blocks.filter(wanted).orderBy("shard", "block").toLocalIterator():
        for k, own in enumerate(b.doc_ids):
            if own == doc_id:
                out.append(unpack(bytes(b.payload)[len(MAGIC) :], b.width, b.offsets[k], b.offsets[k + 1] - b.offsets[k]))
    return out
