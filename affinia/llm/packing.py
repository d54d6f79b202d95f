"""Packing of token sequences by first-fit decreasing.

Documents are dealt at random into groups, each packed by itself, after as many whole sequences as they fill
are cut off. A tournament tree over the room left in each bin finds the first bin that an item fits into in
logarithmic time. What first-fit decreasing leaves open is then filled by cutting the items of the emptiest bins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinia.llm.common import release, wide_rows
from affinia.llm.encode import Encoder, encoder
from affinia.llm.token_store import pack, unpack, width_for


class Bins:
    """Room left in bins, as a tournament tree: each inner node has the most room below it."""

    def __init__(self, n: int, size: int):
        self.leaves = 1
        while self.leaves < max(1, n):
            self.leaves *= 2
        self.best = [size] * (2 * self.leaves)

    def first_fit(self, need: int) -> int:
        """Take ``need`` from the first bin that has it; there is one for every item."""
        best, node = self.best, 1
        while node < self.leaves:
            node *= 2
            if best[node] < need:
                node += 1
        best[node] -= need
        found = node - self.leaves
        while node > 1:
            node //= 2
            top = max(best[2 * node], best[2 * node + 1])
            if best[node] == top:
                break
            best[node] = top
        return found


def plan(lengths: list[int], size: int) -> list[list[tuple[int, int, int]]]:
    """Bins of (item, start, length) pieces for the items of the given lengths.

    A longer item than a bin gives full bins and a rest. The rests, largest first, go to the first bin that
    has room. Then the emptiest bins are dissolved: their items are cut to fill the others, as long as
    these have the room. Ties stand in the order of the items.
    """
    full, rests = [], []
    for item, n in enumerate(lengths):
        whole = n - n % size
        full += [[(item, at, size)] for at in range(0, whole, size)]
        if n > whole:
            rests.append((n - whole, item, whole))
    rests.sort(key=lambda x: (-x[0], x[1]))
    tree, bins = Bins(len(rests), size), []
    for n, item, start in rests:
        at = tree.first_fit(n)
        while len(bins) <= at:
            bins.append([])
        bins[at].append((item, start, n))
    filled = [sum(x[2] for x in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda k: (filled[k], k))
    room = sum(size - x for x in filled)
    gone: set[int] = set()
    for k in order:
        if room - (size - filled[k]) < filled[k]:
            break
        gone.add(k)
        room -= size
    spare = [k for k in reversed(order) if k not in gone and filled[k] < size]
    loose = [x for k in order if k in gone for x in bins[k]]
    for item, start, n in loose:
        while n:
            while filled[spare[0]] == size:
                spare.pop(0)
            take = min(n, size - filled[spare[0]])
            bins[spare[0]].append((item, start, take))
            filled[spare[0]] += take
            start, n = start + take, n - take
    return full + [b for k, b in enumerate(bins) if k not in gone]


#: Ids of the sequences that one document fills begin here, with the task's and the sequence's number behind.
FULL = 1 << 62


def pack_documents(
    docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int | None = 1, group_docs: int = 2048, seed: int = 7, with_ids: bool = False
) -> DataFrame:
    """Pieces of documents in sequences of at most ``size`` tokens.

    docs: doc_id, text. A document's ids are those of its whole text and end_id. Columns: doc_id, start
    (ids of the document before the piece), length, ids_crc32 (of the piece's ids as little-endian unsigned
    32-bit integers), doc_tokens (ids of the document), sequence_id, offset (place in the sequence, gapless
    from 0), and with ``with_ids`` the ids. As many whole sequences as a document fills are its own; the rest,
    under ``size`` ids, goes to one of the groups of about ``group_docs`` documents, dealt by a hash of the
    row's number and seed, which so hold group_docs * size ids at most. Sequence ids of a group begin at group *
    2**32. All but one sequence of a group are filled up, so padding is under ``size`` tokens a group.

    A null text is an empty one: its document is just end_id (no piece if that is None). Repeated rows, and
    rows of one doc_id, are packed each and dealt each by itself. An empty table gives no rows. Other columns
    are ignored.
    """
    width = width_for(max(Encoder(tokenizer).vocabulary, (end_id or 0) + 1))
    chosen = wide_rows(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("rid"))
    tail = np.asarray([] if end_id is None else [end_id], "<u4")
    groups = max(1, -(-docs.count() // group_docs))
    columns = ["rid", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "ids"]

    def encode(it) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        coder, full = encoder(tokenizer), FULL + (TaskContext.get().partitionId() << 40)
        for batch in it:
            rows = []
            for rid, doc_id, own in zip(batch.column(2).to_pylist(), batch.column(0).to_pylist(), coder.encode_many(batch.column(1).to_pylist()), strict=True):
                own = np.concatenate([own, tail])
                whole = len(own) - len(own) % size
                for at in range(0, whole, size):
                    ids = own[at : at + size]
                    rows.append((rid, doc_id, at, size, zlib.crc32(ids.tobytes()), len(own), full, pack(ids, width) if with_ids else None))
                    full += 1
                if whole < len(own):
                    ids = own[whole:]
                    rows.append((rid, doc_id, whole, len(ids), 0, len(own), None, pack(ids, width)))
            kinds = [pa.int64()] * 7 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=columns)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def one_group(table):
        import pyarrow as pa

        release()  # all is encoded by now
        cols = {c: table[c].to_pylist() for c in columns if c != "ids"}
        packed, group = table["ids"], table["group"][0].as_py()
        unpacked = lambda k: unpack(packed[k].as_buffer(), width, 0, cols["length"][k])
        out, pieces = [], []

        def piece(k, start, n, checked, sequence, at, ids):
            out.append((cols["doc_id"][k], start, n, checked, cols["doc_tokens"][k], sequence, at))
            pieces.append(ids.tolist() if with_ids else None)

        rests = []
        for k, sequence in enumerate(cols["sequence_id"]):
            if sequence is None:
                rests.append(k)
            else:
                piece(k, cols["start"][k], cols["length"][k], cols["ids_crc32"][k], sequence, 0, unpacked(k) if with_ids else None)
        rests.sort(key=lambda k: (cols["doc_id"][k] is not None, cols["doc_id"][k] or 0, cols["length"][k], cols["rid"][k]))
        for number, b in enumerate(plan([cols["length"][k] for k in rests], size)):
            at = 0
            for item, start, n in b:
                k = rests[item]
                ids = unpacked(k)[start : start + n]
                piece(k, cols["start"][k] + start, n, zlib.crc32(ids.tobytes()), (group << 32) + number, at, ids)
                at += n
        data = [pa.array([r[j] for r in out], pa.int64()) for j in range(len(names))]
        return pa.table(data + [pa.array(pieces, pa.list_(pa.int64()))] * with_ids, names=names + ["ids"] * with_ids)

    group = F.pmod(F.xxhash64("rid", "start", F.lit(seed)), F.lit(groups)).alias("group")
    coded = chosen.mapInArrow(encode, ", ".join(f"{c} long" for c in columns[:-1]) + ", ids binary").select(*columns, group)
    return coded.groupBy("group").applyInArrow(one_group, ", ".join(f"{x} long" for x in names) + ", ids array<long>" * with_ids)
