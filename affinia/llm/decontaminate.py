"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations only.

The index stores, for the test terms that are among the rarest of some benchmark window, every posting (term,
text, position) of the training texts. An item is searched from these terms: their lists, each adjusted by
the term's place in the item, meet on (item, text, diagonal). A window whose rarest terms meet on a diagonal is
held against the text's words there, which gives the exact phrases; lists that meet on nearby diagonals give
proximity matches. Texts are told apart by a number of their own and items by a hash of their words, and
each row carries places, not words, so that the work is in proportion to the lengths of texts and items.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinia.llm.common import written

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Up to so many bytes, tables made of the benchmark are broadcast; beyond, joins with them shuffle.
BROADCAST_BYTES = 32 << 20
#: Shares that a term's list is dealt to in shuffled joins, since one term may have a third of all postings.
SHARES = 16


def words_of(text: Column) -> Column:
    """Words of a text: runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z in
    lower case. A null text has none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.array_remove(F.split(F.translate(text, _UPPER, _UPPER.lower()), _APART), "")


def _small(df: DataFrame, size: Column | int = 0) -> bool:
    """Whether a written table of longs, but for a column of the given size in bytes, may be broadcast."""
    n = df.agg(F.sum((F.lit(size) if isinstance(size, int) else size) + 8 * len(df.columns) + 16)).first()[0]
    return (n or 0) <= BROADCAST_BYTES


def _by_term(postings: DataFrame, benchmark: DataFrame, small: bool) -> DataFrame:
    """Join by term, with a table made of the benchmark."""
    if small:
        return postings.join(F.broadcast(benchmark), "term")
    share = F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share")
    dealt = postings.withColumn("share", F.pmod(F.xxhash64("rid"), F.lit(SHARES)).cast("int"))
    return dealt.join(benchmark.select("*", share), ["term", "share"]).drop("share")


def texts_of(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, words) of every row, as a written table: a row's number and its words, made once."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words"))
    return written(docs.withColumn("rid", F.monotonically_increasing_id()), "texts")


def items_of(items: DataFrame, width: int, whole_windows: bool = False) -> DataFrame:
    """(item_id, words, width) of the items that have windows: a window is ``width`` consecutive words; all
    words of a shorter item, which ``whole_windows`` leaves out. A null item_id is the empty one."""
    own = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words_of(F.col("text")).alias("words"))
    least = width if whole_windows else 1
    own = own.filter(F.size("words") >= least).dropDuplicates(["item_id", "words"])
    return own.select("item_id", "words", F.least(F.lit(width), F.size("words")).alias("width"))


class Index(NamedTuple):
    """The stored postings (term, rid, pos); places (t, item_pos, term, starts), where starts are the windows
    (start, need) that a term of the item t is to be searched for; windows (t, start, width, h1, h2), with hashes of
    their words; names (t, ids) of the items' texts; and whether places and windows may be broadcast."""

    postings: DataFrame
    places: DataFrame
    windows: DataFrame
    names: DataFrame
    small: bool


def _hashes(words: Column) -> list[Column]:
    return [F.xxhash64(F.lit(k), words) for k in (1, 2)]


def build_index(texts: DataFrame, items: DataFrame, lists: int, absent: bool = False) -> Index:
    """The index of texts (texts_of) for items (items_of).

    Terms are ranked by their count in all texts; each window is searched from its ``lists`` rarest ones.
    Windows with a term that no text holds are left out, since they occur nowhere; with ``absent`` they are
    searched from the rarest terms that there are, for proximity matches.
    """
    one = items.select("item_id", F.xxhash64("words").alias("t"), "words", "width")
    names = written(one.groupBy("t").agg(F.array_sort(F.collect_set("item_id")).alias("ids")), "names")
    one = one.dropDuplicates(["t"])
    at = written(one.select("t", "width", F.size("words").alias("n_words"), F.posexplode("words").alias("item_pos", "term")), "item-terms")
    starts = F.explode(F.sequence(F.lit(0), F.size("words") - F.col("width"))).alias("start")
    here = F.slice("words", F.col("start") + 1, F.col("width"))
    windows = one.select("t", "words", "width", starts).select("t", "start", "width", *(h.alias(n) for h, n in zip(_hashes(here), ("h1", "h2"), strict=True)))
    windows = written(windows, "windows")
    terms = written(at.select("term").distinct(), "terms")
    tokens = texts.select("rid", F.explode("words").alias("term"))
    if _small(terms, F.octet_length("term")):
        counts = tokens.join(F.broadcast(terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    else:
        counts = tokens.groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(terms, "term", "left_semi")
    counts = written(counts, "counts")
    first = F.greatest(F.lit(0), F.col("item_pos") - F.col("width") + 1)
    in_windows = at.join(counts, "term").select("t", "width", "item_pos", "term", "n", F.explode(F.sequence(first, F.least("item_pos", F.col("n_words") - F.col("width")))).alias("start"))
    by_window = Window.partitionBy("t", "start")
    in_windows = in_windows.withColumns({
        "rank": F.row_number().over(by_window.orderBy("n", "term", "item_pos")),
        "present": F.count(F.lit(1)).over(by_window),
    })
    chosen = in_windows.filter((F.lit(absent) | (F.col("present") == F.col("width"))) & (F.col("rank") <= lists))
    whole = F.when(F.col("present") == F.col("width"), F.struct(F.col("start"), F.least("width", F.lit(lists)).alias("need")))
    places = chosen.groupBy("t", "item_pos", "term").agg(F.collect_list(whole).alias("starts"))
    places = written(places, "places")
    needed = written(places.select("term").distinct(), "needed")
    postings = texts.select("rid", F.posexplode("words").alias("pos", "term"))
    postings = written(_by_term(postings, needed, _small(needed, F.octet_length("term"))).select("term", "rid", "pos"), "postings")
    small = _small(places, F.octet_length("term") + 16 * F.size("starts")) and _small(windows)
    return Index(postings, places, windows, names, small)


def meet(index: Index) -> DataFrame:
    """(t, rid, diagonal, item_pos): where a list, less its term's place in the item, has a posting. Rows of an
    item and a text are in one partition, for what is grouped by them."""
    few = index.places.select("t", "item_pos", "term")
    lists = _by_term(index.postings, few, index.small)
    return lists.select("t", "rid", (F.col("pos") - F.col("item_pos")).alias("diagonal"), "item_pos").repartition("t", "rid")


def exact_candidates(index: Index, met: DataFrame) -> DataFrame:
    """(rid, t, at, width, h1, h2): windows whose rarest terms all meet, with their place in the text."""
    pairs = met.groupBy("t", "rid", "diagonal").agg(F.collect_list("item_pos").alias("own"))
    least = index.places.filter(F.exists("starts", lambda s: s["need"] == 1)).select("t").distinct()  # items of one word
    alone = pairs.filter(F.size("own") == 1).join(F.broadcast(least) if index.small else least, "t", "left_semi")
    pairs = pairs.filter(F.size("own") > 1).unionByName(alone)
    pairs = pairs.select("t", "rid", "diagonal", F.explode("own").alias("item_pos"))
    places, windows = index.places.select("t", "item_pos", "starts"), index.windows
    if index.small:
        places, windows = F.broadcast(places), F.broadcast(windows)
    found = pairs.join(places, ["t", "item_pos"]).select("t", "rid", "diagonal", F.explode("starts").alias("s"))
    found = found.groupBy("t", "rid", "diagonal", F.col("s.start").alias("start"), F.col("s.need").alias("need")).agg(F.count(F.lit(1)).alias("n"))
    found = found.filter("n >= need").join(windows, ["t", "start"])
    return found.select("rid", "t", (F.col("start") + F.col("diagonal")).alias("at"), "width", "h1", "h2").filter("at >= 0")


def proximity_matches(met: DataFrame, slack: int, least: int, span: int) -> DataFrame:
    """(t, rid, n_terms): texts where ``least`` or more rare terms of an item, within ``span`` of its words, stand in
    its order up to ``slack`` words inserted or left out; n_terms is the most on such diagonals.

    Diagonals within slack of each other are in one band of that width or in neighbouring ones.
    """
    bands = met.groupBy("t", "rid", F.floor(F.col("diagonal") / slack).alias("band")).agg(F.collect_set("item_pos").alias("own"))
    after = Window.partitionBy("t", "rid").orderBy("band")
    following = F.when(F.lead("band").over(after) == F.col("band") + 1, F.lead("own").over(after))
    both = F.array_sort(F.array_union("own", F.coalesce(following, F.array().cast("array<int>"))))
    bands = bands.select("t", "rid", both.alias("own")).filter(F.size("own") >= least)
    close = F.exists(F.sequence(F.lit(0), F.size("own") - least), lambda k: F.get("own", k + (least - 1)) - F.get("own", k) < span)
    return bands.filter(close).groupBy("t", "rid").agg(F.max(F.size("own")).alias("n_terms"))


def near_matches(docs: DataFrame, items: DataFrame, width: int = 8, lists: int = 4, slack: int = 4, least: int = 3, span: int = 16) -> DataFrame:
    """(doc_id, item_id, n_terms) of the proximity matches of whole tables: what of the items stands in the
    documents with words changed, inserted or left out, such as one in each window.

    docs: doc_id, text; items: item_id, text. Each window is searched from its ``lists`` rarest terms that
    any document holds. Places with exact windows are found too.
    """
    texts = texts_of(docs)
    index = build_index(texts, written(items_of(items, width), "items"), lists, absent=True)
    near = proximity_matches(meet(index), slack, least, span)
    near = near.join(index.names, "t").select("rid", "n_terms", F.explode("ids").alias("item_id"))
    return near.join(texts.select("rid", "doc_id"), "rid").groupBy("doc_id", "item_id").agg(F.max("n_terms").alias("n_terms"))


def match_benchmark(docs: DataFrame, items: DataFrame, width: int = 8, min_items: int = 2, lists: int = 2, whole_windows: bool = False, slack: int | None = None, least: int = 3, span: int = 16) -> DataFrame:
    """What of a benchmark each document holds.

    docs: doc_id, text; items: item_id, text. A window is ``width`` consecutive words of an item; an item
    of fewer words is one window (with ``whole_windows`` such items are left out). Columns: doc_id,
    n_words, n_hit (words inside an occurrence of a window), n_items (items with an occurring window),
    items_sha256 (hex digest of those item ids, sorted as strings and joined by commas), contaminated
    (n_items >= min_items), hits (array of ids, and starts and widths of their windows, words counted from 0), and with
    ``slack`` n_near_items (items without an occurring window of which proximity_matches finds a passage).

    A window's ``lists`` rarest terms are intersected. Null and empty texts, of documents or items, have no
    words and hit nothing. Repeated documents each give a row, judged by its own text, and so do different
    texts of one doc_id, also a null one; repeated items count once; a null item_id is the empty id. Without
    items, or documents, nothing is hit. Other columns are ignored.
    """
    texts = texts_of(docs)
    index = build_index(texts, written(items_of(items, width, whole_windows), "items"), lists, absent=slack is not None)
    met = meet(index)
    found = exact_candidates(index, met).groupBy("rid", "t").agg(F.collect_list(F.struct("at", "width", "h1", "h2")).alias("c"))
    found = found.withColumn("near", F.lit(False))
    if slack is not None:
        near = proximity_matches(met, slack, least, span).select("rid", "t", F.lit(None).cast(found.schema["c"].dataType).alias("c"), F.lit(True).alias("near"))
        found = found.unionByName(near)
    names = F.broadcast(index.names) if index.small and _small(index.names, F.aggregate("ids", F.lit(0), lambda n, x: n + F.octet_length(x) + 16)) else index.names
    found = found.join(names, "t").groupBy("rid").agg(F.collect_list(F.struct("ids", "c", "near")).alias("found"))
    # candidates grow with the documents: the join is by shuffle at every size, of texts as they are shorter
    rows = texts.select("rid", "doc_id", F.size("words").cast("long").alias("n_words"), F.array_join("words", " ").alias("text"))
    rows = rows.join(found.hint("merge"), "rid", "left")
    rows = rows.select("doc_id", "n_words", "found", F.when(F.col("found").isNotNull(), F.split("text", " ")).alias("words"))

    def right(c: Column) -> Column:
        here = F.slice("words", c["at"] + 1, c["width"])
        return (F.size(here) == c["width"]) & (F.xxhash64(F.lit(1), here) == c["h1"]) & (F.xxhash64(F.lit(2), here) == c["h2"])

    places = lambda x: F.transform(F.filter(F.coalesce(x["c"], F.array().cast(found_type)), right), lambda c: F.struct(c["at"].alias("at"), c["width"].alias("width")))
    found_type = "array<struct<at:int,width:int,h1:bigint,h2:bigint>>"
    hits = F.filter(F.transform("found", lambda x: F.struct(x["ids"].alias("ids"), places(x).alias("windows"))), lambda h: F.size(h["windows"]) > 0)
    hits = F.coalesce(hits, F.array().cast("array<struct<ids:array<string>,windows:array<struct<at:int,width:int>>>>"))
    near = F.flatten(F.transform(F.filter(F.coalesce("found", F.array().cast("array<struct<ids:array<string>,c:" + found_type + ",near:boolean>>")), lambda x: x["near"]), lambda x: x["ids"]))
    rows = rows.select("doc_id", "n_words", hits.alias("hits"), near.alias("near"))
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["ids"]))))
    spans = F.array_sort(F.flatten(F.transform("hits", lambda h: h["windows"])))
    rows = rows.select("doc_id", "n_words", "hits", ids.alias("ids"), spans.alias("spans"), "near")
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    end = lambda w: w["at"] + w["width"]
    covered = F.aggregate("spans", start, lambda a, w: F.struct(F.greatest(a["end"], end(w)).alias("end"), (a["n"] + F.greatest(F.lit(0), end(w) - F.greatest(a["end"], w["at"]))).alias("n")), lambda a: a["n"])
    n_items = F.size("ids").cast("long")
    out = rows.select(
        "doc_id",
        "n_words",
        covered.alias("n_hit"),
        n_items.alias("n_items"),
        F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"),
        (n_items >= min_items).alias("contaminated"),
        "hits",
        F.size(F.array_except("near", "ids")).cast("long").alias("n_near_items"),
    )
    return out if slack is not None else out.drop("n_near_items")


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = 8) -> DataFrame:
    """docs, with all its columns, less the documents that hold ``width`` consecutive words of an item.

    Items of fewer words say too little to drop a document for. Rows with a null doc_id are judged together.
    """
    found = match_benchmark(docs, items, width=width, min_items=1, whole_windows=True)
    bad = written(found.filter("contaminated").select(F.col("doc_id").alias("bad_id")).distinct(), "contaminated").hint("merge")
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("bad_id")), "left_anti")
