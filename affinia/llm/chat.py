"""Chat formatting with collapse of cumulative snapshots.

Turns are sorted over the cluster, so that a long conversation runs through several partitions. Each
partition rolls the hash of every turn prefix by itself; what a partition's first conversation brings along
from those before it is a row a partition, by which the hashes of its prefixes are carried on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinia.llm.common import wide_rows, written

#: The marks of the chat template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Modulus and bases of the two rolling hashes.
PRIME, BASES = (1 << 61) - 1, (0x1F3D5B79A2C4E687, 0x0B5E2D41C7F9A863)
#: Rows that a task remembers so as to send repeated ones on once.
REMEMBERED = 200_000

_TURN = "conv_id long, turn long, role string, text string"
_ROLLED = "conv_id long, role string, text string, pid long, local long, h1 long, h2 long, opens boolean, ends boolean, closes boolean"


def turn_digest(role: bytes | None, text: bytes | None) -> tuple[int, int]:
    """Two hashes of a turn; a null differs from every text."""
    import xxhash

    x = xxhash.xxh3_128_intdigest(b"".join(b"-" if v is None else b"%d:%b" % (len(v), v) for v in (role, text)))
    return x % PRIME, (x >> 61) % PRIME


def rolled(prefix: tuple[int, ...], digest: tuple[int, ...], n: int = 1) -> tuple[int, ...]:
    """The hash of a prefix and what follows it: a turn, or n turns by the hash they have on their own."""
    return tuple((h * pow(b, n, PRIME) + d) % PRIME for h, b, d in zip(prefix, BASES, digest, strict=True))


def _digested(it) -> Iterator:
    """Turns with their hashes; a task sends repeated rows on once, as far as it remembers them."""
    import pyarrow as pa

    seen: set[tuple] = set()
    for batch in it:
        keep, one, two = [], [], []
        raw = [[x.as_buffer().to_pybytes() if x.is_valid else None for x in batch.column(k)] for k in (2, 3)]
        for conv, turn, role, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *raw, strict=True):
            d = turn_digest(role, text)
            fresh = (conv, turn, *d) not in seen
            if fresh:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add((conv, turn, *d))
                one.append(d[0])
                two.append(d[1])
            keep.append(fresh)
        own = batch.filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays([*own.columns, pa.array(one, pa.int64()), pa.array(two, pa.int64())], names=[*batch.schema.names, "d1", "d2"])


def _rolling(it) -> Iterator:
    """Sorted turns of a partition, equal ones once: their place in the partition's part of the conversation, the
    hashes of the prefixes they end there, and whether they are of its first conversation (opens), the last
    turn of one there (ends), and of its last one (closes)."""
    import pyarrow as pa
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    last: tuple | None = None
    local, prefix, opens = 0, (0, 0), True
    held = None  # a row is given on when the next one tells whether its conversation ends

    def batch_of(columns, rows, ends, closes):
        local, h1, h2, opens = zip(*rows, strict=True)
        cols = [*columns, pa.array([pid] * len(rows), pa.int64()), *(pa.array(x, pa.int64()) for x in (local, h1, h2))]
        cols += [pa.array(opens, pa.bool_()), pa.array(ends, pa.bool_()), pa.array(closes, pa.bool_())]
        return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _ROLLED.split(", ")])

    for batch in it:
        convs, turns, one, two = (batch.column(k).to_pylist() for k in (0, 1, 4, 5))
        keep, rows, ends = [], [], []
        for k, now in enumerate(zip(convs, turns, one, two, strict=True)):
            if now == last:
                continue
            new = last is None or now[0] != last[0]
            if new:
                if last is not None:
                    opens = False
                local, prefix = 0, (0, 0)
            if rows:
                ends.append(new)
            elif held is not None:
                yield batch_of(*held, [new], [False])
                held = None
            local, prefix = local + 1, rolled(prefix, now[2:])
            keep.append(k)
            rows.append((local, *prefix, opens))
            last = now
        if rows:
            own = batch.take(pa.array(keep, pa.int64()))
            columns = [own.column(k) for k in (0, 2, 3)]
            if len(rows) > 1:
                yield batch_of([c.slice(0, len(rows) - 1) for c in columns], rows[:-1], ends, [False] * (len(rows) - 1))
            held = [c.slice(len(rows) - 1) for c in columns], rows[-1:]
    if held is not None:
        yield batch_of(*held, [True], [True])


class Carry:
    """What each partition's first conversation brings along, and which partitions' last one goes on."""

    def __init__(self, edges: list):
        """edges: the ending rows of each partition's first and last conversation, at most two a partition."""
        self.before: dict[int, tuple[int, int, int]] = {}
        self.continued: set[int] = set()
        conv, n, h, at = None, 0, (0, 0), None
        for e in sorted(edges, key=lambda e: (e.pid, e.closes)):
            own_n, own_h = e.local, (e.h1, e.h2)
            if e.opens and at is not None and e.conv_id == conv:
                self.before[e.pid] = (n, *h)
                self.continued.add(at)
                own_n, own_h = n + e.local, rolled(h, own_h, e.local)
            if e.closes:
                conv, n, h, at = e.conv_id, own_n, own_h, e.pid

    def placed(self, it) -> Iterator:
        """conv_id, place, h1, h2 in the whole conversation, and whether it ends there."""
        import pyarrow as pa

        for batch in it:
            conv, pid, local, h1, h2, opens, ends, closes = batch.columns
            ends = np.asarray(ends).astype(bool)
            place, one, two = (np.array(x) for x in (local, h1, h2))
            for k in np.flatnonzero(np.asarray(opens).astype(bool)):
                if got := self.before.get(pid[k].as_py()):
                    n = int(place[k])
                    one[k], two[k] = rolled(got[1:], (int(one[k]), int(two[k])), n)
                    place[k] = n + got[0]
            on = np.array([ends[k] and closes[k].as_py() and pid[k].as_py() in self.continued for k in range(len(ends))], bool)
            cols = [conv, *(pa.array(x, pa.int64()) for x in (place, one, two)), pa.array(ends & ~on, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=["conv_id", "place", "h1", "h2", "is_end"])


def indexed_turns(turns: DataFrame) -> tuple[DataFrame, Carry]:
    """The turns, sorted and with rolled hashes by partition, as a written table, and what is carried on.

    Turns stand in the order of (turn, role, text), nulls first; equal rows count once.
    """
    spark = turns.sparkSession
    rows = wide_rows(turns).select(*(F.col(c).cast(kind).alias(c) for c, kind in (x.split() for x in _TURN.split(", "))))
    order = ["conv_id", "turn", "role", "text"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.mapInArrow(_digested, _TURN + ", d1 long, d2 long").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    table = written(dealt.mapInArrow(_rolling, _ROLLED), "turns")
    edges = table.filter("ends AND (opens OR closes)").select("conv_id", "pid", "local", "h1", "h2", "opens", "closes").collect()
    return table, Carry(edges)


def maximal_conversations(table: DataFrame, carry: Carry) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that are no prefix of another.

    Of equal conversations the one of the smallest conv_id stays.
    """
    own = table.select("conv_id", "pid", "local", "h1", "h2", "opens", "ends", "closes")
    own = own.mapInArrow(carry.placed, "conv_id long, place long, h1 long, h2 long, is_end boolean")
    same = ["place", "h1", "h2"]
    unique = own.filter("is_end").groupBy(*same).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    prefixes = own.filter("NOT is_end").select(*same).distinct()
    return unique.join(prefixes, same, "left_anti").select("conv_id", F.col("place").alias("n_turns"), "n_copies")


def format_chats(turns: DataFrame, part_turns: int | None = 1024) -> DataFrame:
    """Render the maximal conversations: (conv_id, part, n_turns, n_part_turns, n_copies, text).

    Logged snapshots that another conversation continues go, as do equal copies but one. A conversation
    over ``part_turns`` turns is rendered in parts of so many turns; its text is its parts in order; None
    renders every conversation as one part, which a row then has to hold.
    A null role or text is rendered as an empty one, but is another turn than an empty one. Rows with a null
    conv_id form one conversation. Equal turn rows of a conversation count once; ties of turn numbers stand
    in the order of role and text, and null turn numbers come first. An empty table gives no rows. Other
    columns are ignored.
    """
    table, carry = indexed_turns(turns)
    spark = turns.sparkSession
    size = F.lit(part_turns or 1 << 62)
    before = F.broadcast(spark.createDataFrame([(pid, True, x[0]) for pid, x in carry.before.items()], "b_pid long, b_opens boolean, before long"))  # a row a partition at most
    rows = table.join(before, (F.col("pid") == F.col("b_pid")) & (F.col("opens") == F.col("b_opens")), "left")
    rows = rows.withColumn("place", F.col("local") + F.coalesce("before", F.lit(0)))
    key = [F.coalesce("conv_id", F.lit(0)).alias("c"), F.col("conv_id").isNull().alias("c_null")]
    line = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(CLOSE + "\n"))
    rows = rows.select(*key, F.floor((F.col("place") - 1) / size).cast("long").alias("part"), "place", line.alias("line"))
    kept = maximal_conversations(table, carry)
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_turns") - 1) / size).cast("long"))).alias("part")
    kept = kept.select(*key, "n_turns", "n_copies", parts)
    same = ["c", "c_null", "part"]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "")
    found = rows.join(kept, same).groupBy(*same).agg(F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.count(F.lit(1)).alias("n_part_turns"), text.alias("text"))
    return found.select(F.when(~F.col("c_null"), F.col("c")).alias("conv_id"), "part", "n_turns", "n_part_turns", "n_copies", "text")
