"""MinHash near-duplicates by an inverted join on signature coordinates.

Documents of equal shingle sets are one node. A node's signature has a number of coordinates, each made of
a few min-hashes. Nodes are posted under coordinate-value pairs: values that only one node has are skipped,
the others stand in the order of how rare they are, and only the prefix that two signatures with enough
equal coordinates must share is merged. Within a posting list every node meets the list's smallest one; the
links found are joined into components, and then only nodes outside a list's main component meet those
others that they can still be linked with by what both differ from the smallest one in, so that a list of
many near copies is never expanded into all its pairs. The equal coordinates of such a pair are counted, and
those above the threshold are confirmed on the full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinia.llm.common import Memo, free, mark, release, wide_rows, written
from affinia.llm.components import components

_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, width: int, memo: Memo) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words; of all words if there are fewer."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    seed = len(words) if len(words) < width else 0  # fewer words are no shingle that longer texts have
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, seed, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = (out ^ own[k : k + n]) * _MIX
            out ^= out >> np.uint64(29)
    return np.unique(out)


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_229)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def signature(found: np.ndarray, coordinates: int, width: int) -> np.ndarray:
    """One 64-bit token for each coordinate, of ``width`` min-hashes and the coordinate's number."""
    a, b = _multipliers(coordinates * width)
    least = np.full(coordinates * width, np.iinfo(np.uint64).max, np.uint64)
    step = max(1, (1 << 19) // len(a))
    with np.errstate(over="ignore"):
        for at in range(0, len(found), step):
            least = np.minimum(least, (found[at : at + step, None] * a + b).min(axis=0))
        out = np.arange(coordinates, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for k in range(width):
            out = (out ^ least[k * coordinates : (k + 1) * coordinates]) * _MIX
            out ^= out >> np.uint64(31)
    return out


def match_threshold(coordinates: int, width: int, similarity: float, miss: float = 1e-7) -> int:
    """Most equal coordinates that a pair of the given similarity has with probability 1 - miss at least."""
    p, total = similarity**width, 0.0
    for k in range(coordinates + 1):
        total += math.comb(coordinates, k) * p**k * (1 - p) ** (coordinates - k)
        if total > miss:
            return max(1, k)
    return coordinates


def _word_memo() -> Memo:
    import xxhash

    return Memo(xxhash.xxh3_64_intdigest, 100_000)  # hashing is fast; a worker's memory counts for more


def sketches(docs: DataFrame, shingle: int, coordinates: int, width: int) -> DataFrame:
    """(doc_id, n_shingles, digest, sig): the digest tells shingle sets apart, null without words."""

    def rows(it) -> Iterator:
        import pyarrow as pa
        import xxhash

        release()
        memo = _word_memo()
        for batch in it:
            n, digests, sigs = [], [], []
            for text in batch.column(1):
                found = shingles(text.as_buffer().to_pybytes(), shingle, memo) if text.is_valid else ()
                n.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                sigs.append(signature(found, coordinates, width).view(np.int64) if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "sig"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, n_shingles long, digest binary, sig array<long>")


def shared_tokens(nodes: DataFrame, coordinates: int, need: int) -> DataFrame:
    """(id, n, shared, prefix) of the nodes that have ``need`` tokens or more in common with other nodes.

    In the order of (count, token), values of a single node come first; they match nothing, so they only
    shorten the prefix that has to be merged.
    """
    tokens = nodes.select("id", F.explode("sig").alias("token"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    own = tokens.join(counts, "token").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("c", "token"))).alias("t"))
    own = own.filter(F.size("t") >= need)
    shared = F.transform("t", lambda x: x["token"])
    own = own.select("id", shared.alias("shared"), F.slice(shared, F.lit(1), F.size("t") - need + 1).alias("prefix"))
    return own.join(nodes.select("id", "n"), "id")


def _estimated(pairs: DataFrame, cand: DataFrame, need: int) -> DataFrame:
    """Pairs with ``need`` equal coordinates or more."""
    for side in ("a", "b"):
        pairs = pairs.join(cand.select(F.col("id").alias(side), F.col("shared").alias(f"s_{side}")), side)
    return pairs.filter(F.size(F.array_intersect("s_a", "s_b")) >= need).select("a", "b")


def _full_sets(docs: DataFrame, chosen: DataFrame, shingle: int) -> DataFrame:
    """(id, items): the sorted shingle hashes of the chosen nodes, from their documents' whole texts."""

    def rows(it) -> Iterator:
        import pyarrow as pa

        memo = _word_memo()
        for batch in it:
            found = [shingles(x.as_buffer().to_pybytes(), shingle, memo).tobytes() if x.is_valid else b"" for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["id", "items"])

    own = docs.join(chosen, F.col("doc_id") == F.col("id"), "left_semi").select("doc_id", "text")
    return own.mapInArrow(rows, "id long, items binary")


#: 64-bit words of the bit map of what two sets differ in.
_WORDS = 8


def _bit_map(items: np.ndarray) -> tuple[np.ndarray, int]:
    """A bit for each item, and how many items found theirs set already."""
    with np.errstate(over="ignore"):
        places = (items * _MIX) >> np.uint64(64 - (64 * _WORDS - 1).bit_length())
    bits = np.zeros(64 * _WORDS, bool)
    bits[places.astype(np.int64)] = True
    return np.packbits(bits).view(np.int64), len(items) - int(bits.sum())


def _common(pairs: DataFrame, sets: DataFrame, maps: bool = False) -> DataFrame:
    """(a, b, n_a, n_b, common): set sizes and what the full sets of each pair have in common; with
    ``maps`` also bit maps of what b lacks and adds, against a, with the items beyond one a bit."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("id").alias(side), F.col("items").alias(f"x_{side}")), side)
    names = ["a", "b", "n_a", "n_b", "common", *["lack_map", "lack_more", "add_map", "add_more"] * maps]

    def rows(it) -> Iterator:
        import pyarrow as pa

        for batch in it:
            out = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.intersect1d(x, y, assume_unique=True)
                row = [len(x), len(y), len(both)]
                if maps:
                    row += [*_bit_map(np.setdiff1d(x, both, True)), *_bit_map(np.setdiff1d(y, both, True))]
                out.append(row)
            kinds = [pa.int64()] * 3 + [pa.list_(pa.int64()), pa.int64()] * 2 * maps
            cols = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=names)

    schema = "a long, b long, n_a long, n_b long, common long" + ", lack_map array<long>, lack_more long, add_map array<long>, add_more long" * maps
    return pairs.select("a", "b", "x_a", "x_b").mapInArrow(rows, schema)


def _met(count: str, bits: str, more: str) -> Column:
    """Upper bound of what two nodes have in common in a part of their difference from the head."""
    shared = sum((F.bit_count(F.col(bits)[k].bitwiseAND(F.col(f"o_{bits}")[k])) for k in range(_WORDS)), F.lit(0))
    return F.least(F.col(count), F.col(f"o_{count}"), shared + F.least(more, f"o_{more}"))


def _linked(percent: int) -> Column:
    return 100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))


def _own_items(sets: DataFrame, chosen: DataFrame) -> DataFrame:
    """(id, own): how many items of a chosen node no other chosen node has. Hash collisions lower it."""

    def rows(it) -> Iterator:
        import pyarrow as pa

        for batch in it:
            for node, items in zip(batch.column(0), batch.column(1), strict=True):
                items = np.frombuffer(items.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(items), pa.array(np.full(len(items), node.as_py()))], names=["item", "id"])

    items = sets.join(chosen, "id", "left_semi").select("id", "items").mapInArrow(rows, "item long, id long")
    alone = items.groupBy("item").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id")).filter("c = 1")
    return alone.groupBy("id").agg(F.count(F.lit(1)).alias("own"))


#: Rows under one head that a join or a pairing has in one task.
SHARE_ROWS = 256


def _dealt(rows: DataFrame, shares: str = "shares") -> DataFrame:
    """rows with the share of their head that they are dealt to by id."""
    return rows.withColumn("share", F.pmod(F.xxhash64("id"), F.col(shares)).cast("int"))


def _for_each_share(heads: DataFrame) -> DataFrame:
    """A row of heads for each share of the head."""
    return heads.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))


#: Heads that have more than one in so many of all rows are so few that they may be broadcast.
FEW_HEADS = 1000


def _of_heads(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """The rows (a written table) of heads (with n, their numbers of rows), joined: by broadcast with heads that
    have a large part of the rows, of which there are FEW_HEADS at most, by shuffle with the others."""
    least = max(SHARE_ROWS, rows.count() // FEW_HEADS)
    large = F.broadcast(heads.filter(F.col("n") > least).drop("n"))
    rest = rows.join(large.select("head"), "head", "left_anti").join(heads.filter(F.col("n") <= least).drop("n"), "head")
    return rows.join(large, "head").unionByName(rest)


def _across(placed: DataFrame, stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a list in different components that can still be linked.

    placed: token, id, comp, head; stars: as _common() with maps gives it. Sets linked at t differ in at
    most (1 - t) / (1 + t) of their sizes' sum. By what two nodes of a list differ from its head in - items
    they lack and items they add, of which their own ones are shared with nobody - the size of that
    difference is bounded from below; bit maps bound what they lack or add together. Lists of one head
    meet at once. Only pairs within the bounds are made, and nodes that are in no such pair, judged by the
    best values under their head, leave first. A head with many nodes is dealt to shares, and so are the sizes
    that two linked sets can have, so that no task has all of a head.
    """
    under = written(placed.select("head", "id", "comp").distinct(), "under-heads")
    sizes = under.groupBy("head", "comp").agg(F.count(F.lit(1)).alias("c"))
    main = sizes.groupBy("head").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count(F.lit(1)).alias("k"), F.sum("c").alias("n")).filter("k > 1")
    main = written(main.select("head", "main", "n", F.ceil(F.col("n") / SHARE_ROWS).cast("int").alias("shares")), "open-heads")
    rows = written(_dealt(_of_heads(under, main)), "open-lists")
    own = _own_items(sets, rows.select("id").distinct())
    none = F.array(*[F.lit(0).cast("long")] * _WORDS)
    zero = F.lit(0).cast("long")
    size = F.floor(F.length("items") / 8)
    heads = sets.join(rows.select(F.col("head").alias("id")).distinct(), "id", "left_semi").select(
        F.col("id").alias("a"), F.col("id").alias("b"), size.alias("n_a"), size.alias("n_b"), size.alias("common"),
        none.alias("lack_map"), zero.alias("lack_more"), none.alias("add_map"), zero.alias("add_more"),
    )
    told = stars.unionByName(heads).withColumnsRenamed({"a": "head", "b": "id"})
    rows = rows.join(told, ["head", "id"]).join(own, "id", "left")
    lacks, adds = F.col("n_a") - F.col("common"), F.col("n_b") - F.col("common")
    share = (100 - percent) / (100 + percent)
    rows = rows.withColumns({"size": F.col("n_b"), "lacks": lacks, "alike": F.greatest(F.lit(0), adds - F.coalesce("own", F.lit(0))), "apart": lacks + adds})
    reach = 2 * (F.col("lacks") + F.col("alike")) - F.col("apart") + share * F.col("size")
    claim = F.col("apart") - share * F.col("size")
    kept = ["id", "comp", "size", "lacks", "alike", "apart", "lack_map", "lack_more", "add_map", "add_more"]
    rows = written(rows.select("head", "main", "shares", "share", *kept, reach.alias("reach"), claim.alias("claim")), "open-lists")
    best = rows.groupBy("head", "shares").agg(F.max("reach").alias("top"), F.min("claim").alias("low"))
    rows = rows.join(_for_each_share(best).drop("shares"), ["head", "share"]).filter((F.col("claim") <= F.col("top") + 1e-6) & (F.col("reach") >= F.col("low") - 1e-6))
    # sizes of a linked pair are in one band or in neighbouring ones
    band = F.floor(F.log("size") / (1.001 * math.log(100 / percent))) if percent < 100 else F.col("size")
    rows = written(rows.withColumn("band", band.cast("long")), "open-lists")
    near_bands = F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)) if percent < 100 else F.col("band")
    outside = _for_each_share(rows.filter("comp <> main").drop("share")).withColumn("band", near_bands)
    outside = outside.select("head", "share", "band", *(F.col(c).alias(f"o_{c}") for c in kept))
    met = _met("lacks", "lack_map", "lack_more") + _met("alike", "add_map", "add_more")
    fits = 100 * F.least("size", "o_size") >= percent * F.greatest("size", "o_size")
    near = 2 * met >= F.col("apart") + F.col("o_apart") - share * (F.col("size") + F.col("o_size")) - 1e-6
    other = F.col("comp") != F.col("o_comp")
    pairs = rows.select("head", "share", "band", *kept).join(outside, ["head", "share", "band"]).filter(other & fits & near)
    pairs = pairs.select(F.least("id", "o_id").alias("a"), F.greatest("id", "o_id").alias("b")).distinct()
    return pairs.join(stars.select("a", "b"), ["a", "b"], "left_anti")


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, coordinates: int = 64, width: int = 2
) -> DataFrame:
    """Components of documents linked by Jaccard similarity of word shingles.

    docs: doc_id, text. Words are runs without ASCII white space, A-Z in lower case; a set holds the
    distinct runs of ``shingle`` words, or all words as one run where there are fewer. Documents are linked
    at ``percent`` of 100 or more, confirmed on full sets; a linked pair is missed with a probability of
    1e-7 at most. Columns: doc_id, n_shingles, component_id (smallest doc_id reachable, itself included),
    kept (doc_id = component_id).

    Null, empty and wordless texts have an empty set, no links and are their own component. Rows with a
    null doc_id are ignored. Rows that share a doc_id are one node, linked with what any of them is linked
    with; each gives a row. An empty table gives no rows. Other columns are ignored.
    """
    docs = wide_rows(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.filter("doc_id IS NOT NULL")
    need = match_threshold(coordinates, width, percent / 100)
    begin = mark()
    drawn = written(sketches(docs, shingle, coordinates, width), "sketches")
    nodes = drawn.filter("digest IS NOT NULL").groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "sig")).alias("x"))
    nodes = written(nodes.select("digest", F.col("x.doc_id").alias("id"), F.col("x.n_shingles").alias("n"), F.col("x.sig").alias("sig")), "nodes")
    cand = written(shared_tokens(nodes, coordinates, need), "candidates")
    sets = written(_full_sets(docs, cand.select("id"), shingle), "full-sets")

    postings = written(cand.select("id", F.explode("prefix").alias("token")), "postings")
    heads = postings.groupBy("token").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    lists = written(postings.join(heads.select("token", "head"), "token"), "lists")
    pairs = lists.filter("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    stars = written(_common(pairs, sets, maps=True), "stars")
    joined = written(components(stars.filter(_linked(percent)).select("a", "b")), "star-components")
    placed = lists.join(joined, "id", "left").select("token", "id", "head", F.coalesce("component", "id").alias("comp"))
    across = _estimated(_across(placed, stars, sets, percent), cand, need)
    more = _common(across, sets).filter(_linked(percent)).select("a", "b")
    edges = joined.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more)
    final = written(components(edges), "components")
    free(docs.sparkSession, begin, drawn, nodes, final)
    reps = nodes.select("digest", "id").join(final, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    reps = reps.withColumnRenamed("digest", "rep_digest")
    out = drawn.select("doc_id", "n_shingles", "digest").join(reps, F.col("digest") == F.col("rep_digest"), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """One document of each component, with all columns of docs; rows that repeat a doc_id go too.

    Rows with a null doc_id stay.
    """
    found = near_duplicates(docs, **how).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    kept = docs.join(found, F.col("doc_id") == F.col("kept_id"), "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.filter("doc_id IS NULL"))
