"""Quality rules: counts of a document and a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed unigrams and bigrams of words: one of trusted documents
and one of all documents. Its mean over the n-grams of a document is held against a fixed threshold, which
lets all but a small share of trusted documents pass that took no part in the trusted multinomial.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinia.llm.common import Memo, free, mark, wide_rows, written

_SYMBOLS = bytes(b"#*$%&|<>")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def buckets_of(words: list[bytes], memo: Memo, buckets: int) -> np.ndarray:
    """Bucket of every unigram and bigram; ``buckets`` is a power of two."""
    own = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        two = (own[:-1] * np.uint64(3) + own[1:]) * _ODD
    bits = np.uint64(64 - (buckets.bit_length() - 1))
    return np.concatenate([(own * _ODD) >> bits, two >> bits]).astype(np.int64)


def word_counts(text: bytes, words: list[bytes]) -> tuple[int, int, int, int]:
    """Code points in words, symbols, repeated lines, words in repeated three-word windows."""
    solid = b"".join(words)
    word_chars = len(solid) - solid.translate(None, bytes(range(0x80))).translate(None, bytes(range(0xC0, 0x100))).__len__()
    n_symbols = len(solid) - len(solid.translate(None, _SYMBOLS))
    seen: set[bytes] = set()
    dup_lines = 0
    if b"\n" in text:
        for line in text.split(b"\n"):
            if line in seen:
                dup_lines += 1
            elif line and not line.isspace():
                seen.add(line)
    n = len(words)
    if n < 4:
        return word_chars, n_symbols, dup_lines, 0
    ids: dict[bytes, int] = {}
    own = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) < 1 << 20:
        key = (own[:-2] << 40) | (own[1:-1] << 20) | own[2:]
    else:
        pairs = np.unique(own[:-1] * len(ids) + own[1:], return_inverse=True)[1]
        key = pairs[:-1] * len(ids) + own[2:]
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    again = count[inverse] > 1
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k : n - 2 + k] |= again
    return word_chars, n_symbols, dup_lines, int(hit.sum())


#: Trusted ids are ranked within so many ranges of their hashes, a power of two.
_RANGES = 1 << 12
#: More trusted ids than these meet the documents by shuffle.
BROADCAST_IDS = 1_000_000


def halves(trusted: DataFrame) -> tuple[DataFrame, int]:
    """(t_id, half) of every distinct trusted id, and their number. In the order of their hashes, halves 1 and 2
    take turns. Ranks are made within ranges of hashes, a row for each of which gives the ranks before it."""
    ids = trusted.select(F.col("doc_id").cast("long").alias("t_id")).filter("t_id IS NOT NULL").distinct()
    ids = ids.withColumn("h", F.xxhash64("t_id")).withColumn("part", F.shiftright("h", 65 - _RANGES.bit_length()))
    sizes = sorted(tuple(r) for r in ids.groupBy("part").count().collect())
    before = np.cumsum([0] + [n for _, n in sizes]).tolist()
    bases = trusted.sparkSession.createDataFrame([(part, base) for (part, _), base in zip(sizes, before, strict=False)], "b_part long, base long")
    rank = F.row_number().over(Window.partitionBy("part").orderBy("h", "t_id")) - 1
    ids = ids.withColumn("rank", rank).join(F.broadcast(bases), F.col("part") == F.col("b_part"))
    return ids.select("t_id", (1 + (F.col("base") + F.col("rank")) % 2).cast("int").alias("half")), before[-1]


def _chosen(docs: DataFrame) -> DataFrame:
    return wide_rows(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _met(flags: DataFrame, n: int) -> DataFrame:
    return F.broadcast(flags) if n <= BROADCAST_IDS else flags


def fit(docs: DataFrame, flags: DataFrame, n: int, buckets: int) -> np.ndarray:
    """Log ratios by bucket: raw counts come from every document, trusted ones from every document of half 1 of
    the ``n`` trusted ids."""
    rows = docs.join(_met(flags, n), F.col("doc_id") == F.col("t_id"), "left")
    rows = rows.select("text", F.coalesce("half", F.lit(0)).alias("half"))

    def count(it) -> Iterator:
        import pyarrow as pa

        memo = Memo(word_hash)
        total = np.zeros((2, buckets), np.int64)
        for batch in it:
            for text, half in zip(batch.column(0), batch.column(1), strict=True):
                if text.is_valid:
                    got = np.bincount(buckets_of(text.as_buffer().to_pybytes().split(), memo, buckets), minlength=buckets)
                    total[0] += got
                    if half.as_py() == 1:
                        total[1] += got
        used = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (used, *total[:, used])], names=["bucket", "raw", "target"])

    sums = rows.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target"))
    raw, target = np.ones(buckets), np.ones(buckets)
    for bucket, a, b in sums.collect():
        raw[bucket] += a
        target[bucket] += b
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def threshold_of(docs: DataFrame, flags: DataFrame, n: int, ratio: np.ndarray, keep_share: float) -> float:
    """The score that all but 1 - keep_share of the documents of half 2 reach; those without words count not.

    It is a row of the sorted scores: the partition it is in follows from their numbers of rows. Ids too many
    for a broadcast meet the scores of all documents, so that no text is shuffled for it.
    """
    kept, same, begin = _met(flags.filter("half = 2"), n), F.col("doc_id") == F.col("t_id"), mark()
    if n <= BROADCAST_IDS:
        docs = docs.join(kept, same, "left_semi")
    held = score(docs, ratio, -np.inf, 0, 1 << 62).filter("score IS NOT NULL").select("doc_id", "score")
    if n > BROADCAST_IDS:
        held = held.join(kept, same, "left_semi")
    held = written(held.select("score"), "held-scores")  # a sort by range reads its rows twice
    ranked = written(held.orderBy("score").select("score", F.monotonically_increasing_id().alias("place")), "ranked-scores")
    sizes = sorted(tuple(r) for r in ranked.groupBy(F.shiftright("place", 33).alias("part")).count().collect())
    rank, least = int(sum(c for _, c in sizes) * (1 - keep_share)), -np.inf
    for part, c in sizes:
        if rank < c:
            least = ranked.filter(F.col("place") == (part << 33) + rank).first()[0]
            break
        rank -= c
    free(docs.sparkSession, begin)
    return least


def score(docs: DataFrame, ratio: np.ndarray, threshold: float, min_words: int, max_repeat: int) -> DataFrame:
    buckets = len(ratio)

    def rows(it) -> Iterator:
        import pyarrow as pa

        memo = Memo(word_hash)
        for batch in it:
            out = []
            for text in batch.column(1):
                text = text.as_buffer().to_pybytes() if text.is_valid else b""
                words = text.split()
                chars, symbols, lines, again = word_counts(text, words)
                mean = float(ratio[buckets_of(words, memo, buckets)].mean()) if words else None
                failed = len(words) < min_words or 100 * again > max_repeat * len(words)
                out.append((len(words), chars, symbols, lines, again, failed, not failed and mean is not None and mean >= threshold, mean))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
            cols = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=names)

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"
    return docs.select("doc_id", "text").mapInArrow(rows, schema)


def quality_rules(
    docs: DataFrame,
    trusted: DataFrame,
    buckets: int = 1 << 14,
    keep_share: float = 0.998,
    min_words: int = 50,
    max_repeat: int = 50,
) -> DataFrame:
    """Counts, base rules and the verdict of every document.

    docs: doc_id, text; trusted: doc_id of trusted documents. Words are runs without ASCII white space of
    the whole text. Columns: doc_id, n_words, word_chars (code points in words), n_symbols (characters of
    ``#*$%&|<>``), n_dup_lines (lines with a word that equal an earlier line), n_repeat_words (words in
    three-word windows that occur twice or more), base_failed, kept, score (mean log ratio a hashed
    n-gram). ``kept`` is false for base_failed documents, else score >= threshold.

    All trusted documents take part: by the order of their id hashes, every other one fits the trusted multinomial
    and the rest the threshold, which is an order statistic of all their scores; rows that repeat a trusted id all
    count where it does. The raw multinomial is that of all documents. Without trusted documents every score is 0
    and passes. Null and empty texts have no words, fail the base rules and have a null score. Rows that
    repeat are rated each; an id that trusted repeats counts once. An empty table gives no rows.
    Other columns are ignored.
    """
    docs = _chosen(docs)
    flags, n = halves(trusted)
    ratio = fit(docs, flags, n, buckets) if n else np.zeros(buckets)
    threshold = threshold_of(docs, flags, n, ratio, keep_share) if n else -np.inf
    return score(docs, ratio, threshold, min_words, max_repeat)
