"""Language identification by nearest centroids of TF-IDF vectors of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinia.llm.common import release, wide_rows

UNKNOWN = "und"
#: Languages a model may have; their counts go to the driver.
MOST_LANGUAGES = 10_000


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(x).isalpha() or "̀" <= chr(x) <= "ͯ" for x in range(0x110000)), bool, 0x110000)


def gram_counts(text: str | None, size: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Hash buckets and counts of the character 1-, 2- and 3-grams of a whole text; None without a letter.

    The text is taken in lower case; each run of other characters than letters is one boundary. ``size`` is
    a power of two. Long texts are counted piece by piece, so that memory stays near that of the text.
    """
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    stay = letter.copy()
    stay[1:] |= letter[:-1]
    codes = np.concatenate([np.zeros(1, np.uint32), np.where(letter, codes, 0)[stay], np.zeros(1, np.uint32)])
    bits = np.uint32(32 - (size.bit_length() - 1))
    total = np.zeros(size, np.int64)
    with np.errstate(over="ignore"):
        for at in range(0, len(codes), 1 << 20):
            c = codes[max(0, at - 2) : at + (1 << 20)]
            new = 2 if at else 0  # the grams that end before the piece are counted
            one = c * np.uint32(0x9E3779B1)
            two = (one[:-1] ^ np.uint32(0x85EBCA6B)) * np.uint32(31) + one[1:] * np.uint32(0xC2B2AE35)
            three = (two[:-1] ^ np.uint32(0x27D4EB2F)) * np.uint32(0x165667B1) + one[2:]
            grams = [one[new:][c[new:] > 0], two[max(0, new - 1) :], three]
            for g in grams:
                g = (g ^ (g >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                total += np.bincount(g >> bits, minlength=size)
    used = np.flatnonzero(total)
    return used, total[used]


@dataclass
class Centroids:
    idf: np.ndarray
    vectors: np.ndarray  # buckets x centroids
    langs: list[str]  # by centroid
    floor: np.ndarray  # least similarity by centroid

    def vector(self, found: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        used, count = found
        x = (1 + np.log(count)) * self.idf[used]
        return used, x / max(np.sqrt((x * x).sum()), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine similarity to its nearest centroid, whether that is too far."""
        found = gram_counts(text, len(self.idf))
        if found is None or not self.langs:
            return UNKNOWN, 0.0, True
        used, x = self.vector(found)
        near = x @ self.vectors[used]
        best = int(near.argmax())
        return self.langs[best], float(min(1.0, max(0.0, near[best]))), bool(near[best] < self.floor[best])


def _clusters(rows: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means from a farthest-first start: one row a cluster, each of length 1."""
    centres = [rows.mean(axis=0)]
    nearest = rows @ (centres[0] / max(np.linalg.norm(centres[0]), 1e-12))
    for _ in range(1, min(k, len(rows))):
        centres.append(rows[int(nearest.argmin())])
        nearest = np.maximum(nearest, rows @ centres[-1])
    centres = np.array(centres)
    for _ in range(rounds):
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        own = (rows @ centres.T).argmax(axis=1)
        centres = np.array([rows[own == j].sum(axis=0) if (own == j).any() else centres[j] for j in range(len(centres))])
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)


def fit(
    labelled: DataFrame, per_language: int = 1000, size: int = 1 << 12, k: int = 4, rounds: int = 8, slack: float = 0.3
) -> Centroids:
    """Fit centroids to at most ``per_language`` labelled documents of each language.

    labelled: doc_id, text, lang. The sample of a language holds its documents of the smallest id hashes; equal
    rows count once, and of rows that share an id those of the smallest text hashes come first.
    ``slack`` times the least similarity among a centroid's own documents is its rejection threshold.
    """
    ids = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t"))
    sizes = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("c")).limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return Centroids(np.ones(size), np.zeros((size, 0)), [], np.zeros(0))
    # hashes are uniform, so this share holds the smallest ones; a frequent language sends few rows on
    shares = [(r[0], min(1.0, (1.5 * per_language + 100) / r[1])) for r in sizes]
    shares = F.broadcast(labelled.sparkSession.createDataFrame(shares, "s_lang string, share double"))
    place = (F.col("h") / float(2**63) + 1) / 2
    ids = ids.join(shares, F.col("lang") == F.col("s_lang")).filter(place <= F.col("share")).select("doc_id", "lang", "h", "t").distinct()
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "t")
    ids = ids.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_language)
    chosen = [tuple(r) for r in ids.select("doc_id", "lang", "t").collect()]
    wanted = labelled.sparkSession.createDataFrame(chosen, "w_id long, w_lang string, w_text long")
    same = F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("lang") == F.col("w_lang")) & (F.xxhash64("text") == F.col("w_text"))
    rows = labelled.join(F.broadcast(wanted), same).dropDuplicates(["w_id", "w_lang", "w_text"])

    def count(it) -> Iterator:
        import pyarrow as pa

        for batch in it:
            langs, used, counts = [], [], []
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                if found := gram_counts(text.as_py(), size):
                    langs.append(lang.as_py())
                    used.append(found[0].astype(np.int32).tobytes())
                    counts.append(found[1].astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(used, pa.binary()), pa.array(counts, pa.binary())], names=["lang", "used", "counts"])

    found = rows.select("lang", "text").mapInArrow(count, "lang string, used binary, counts binary").collect()
    found = sorted((r[0], bytes(r[1]), bytes(r[2])) for r in found)
    df = np.zeros(size)
    for _, used, _ in found:
        df[np.frombuffer(used, np.int32)] += 1
    model = Centroids(np.log((1 + len(found)) / (1 + df)) + 1, np.zeros((size, 0)), [], np.zeros(0))
    vectors, floors = [], []
    for lang in sorted({x[0] for x in found}):
        own = [x for x in found if x[0] == lang]
        dense = np.zeros((len(own), size), np.float32)
        for row, (_, used, counts) in zip(dense, own, strict=True):
            at, x = model.vector((np.frombuffer(used, np.int32), np.frombuffer(counts, np.int64)))
            row[at] = x
        centres = _clusters(dense, k, rounds)
        near = dense @ centres.T
        best = near.argmax(axis=1)
        for j in range(len(centres)):
            model.langs.append(lang)
            vectors.append(centres[j])
            floors.append(slack * float(near[:, j][best == j].min() if (best == j).any() else near.min()))
    model.vectors, model.floor = np.array(vectors, np.float64).T.copy(), np.array(floors)
    return model


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def identify(docs: DataFrame, model: Centroids) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of each whole text.

    score is the cosine similarity to the nearest centroid. A null text, one without a letter, and every
    text if nothing was learned is ``und`` with score 0, rejected. A text farther from its nearest centroid
    than the centroid's threshold keeps its prediction and is rejected. Equally near centroids count in the order
    of their languages. Each input row gives one output row; an empty table gives none. Other columns are
    ignored.
    """

    def rows(it) -> Iterator:
        import pyarrow as pa

        release()
        for batch in it:
            found = [model.predict(text.as_py()) for text in batch.column(1)]
            cols = [pa.array([r[j] for r in found], kind) for j, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "lang_pred", "score", "rejected"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(rows, "doc_id long, lang_pred string, score double, rejected boolean")


def detect_language(docs: DataFrame, per_language: int = 1000, size: int = 1 << 12, k: int = 4, slack: float = 0.3) -> DataFrame:
    """Fit on labelled documents that aren't held out, then identify every document.

    docs: doc_id, text, lang. A document is held out where crc32 of the text of doc_id leaves 1 modulo 3.
    lang, source and doc_id are no input of a prediction. See ``fit`` and ``identify`` for bounds and
    edge cases; a null doc_id is never held out and never learned from.
    """
    chosen = wide_rows(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = fit(chosen.filter(F.col("doc_id").isNotNull() & ~held_out()), per_language, size, k, slack=slack)
    found = identify(chosen, model)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame, model: Centroids) -> DataFrame:
    """docs, with all its columns, less the rows that ``identify`` rejects."""
    at = docs.columns.index("text")

    def rows(it) -> Iterator:
        import pyarrow as pa

        release()
        for batch in it:
            keep = [not model.predict(text.as_py())[2] for text in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return wide_rows(docs).mapInArrow(rows, docs.schema)
