"""Language identification by rank-order profiles.

A profile is a language's most frequent letter n-grams (1 to 3 letters, words set off by a
blank) in order of frequency. A document's own most frequent n-grams are ranked the same way,
and its distance to a profile is the sum, over its n-grams, of how far each stands from its place
there; an n-gram the profile lacks counts as out of place by the profile's whole length. The
nearest profile wins; a tie goes to the smaller language name.

The profiles are learnt from a bounded number of texts a language (``PER_LANGUAGE``, those with the
smallest hashes), whole texts each; everything else runs over all rows. Ties of frequency go to the
smaller n-gram, so a profile does not depend on the order of rows.

Defined results: a text that is null or has no letters is ``und`` with score 0, and so is every text
if nothing could be learnt; null and repeated ids give a row each; a language value of null or '' is
not learnt; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tabloom.llm.common import as_long, table, written

#: Texts learnt from for each language, n-grams in a profile and in a document's ranking.
PER_LANGUAGE, PROFILE = 1500, 400
#: A column with more values is refused: it does not hold languages.
MOST_LANGUAGES = 10_000
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def grams(text: str) -> np.ndarray:
    """All n-grams of a text as numbers: code points of 21 bits each, a blank between words."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _is_letter()[points]
    if not letter.any():
        return np.empty(0, np.int64)
    points = np.where(letter, points, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one blank after each word
    points = np.concatenate([[32], points[keep], [32]])
    two = (points[:-1] << 21) | points[1:]
    three = (two[:-1] << 21) | points[2:]
    return np.concatenate([points[points != 32], two[two != (32 << 21 | 32)], three])


def ranked(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n most frequent codes, ties by code, and their counts."""
    values, counts = np.unique(codes, return_counts=True)
    if len(values) > n:
        least = np.partition(counts, len(counts) - n)[len(counts) - n]
        some = counts >= least
        values, counts = values[some], counts[some]
    order = np.argsort(-counts, kind="stable")[:n]
    return values[order], counts[order]


def _count_grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lang in sorted(set(langs)):
            found = [grams(t) for t, x in zip(batch.column(1).to_pylist(), langs) if x == lang]
            codes, counts = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes), pa.array(counts.astype(np.int64))], ["lang", "gram", "n"])


def learn(labelled: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", per_language: int = PER_LANGUAGE, size: int = PROFILE) -> DataFrame:
    """Profiles ``(lang, rank, gram)`` from rows with a language and a text."""
    rows = labelled.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"), F.xxhash64(F.col(f"`{key}`"), F.length(F.col(f"`{text}`"))).alias("h"))
    rows = rows.filter((F.col("lang") != "") & F.col("text").isNotNull())
    # a share of each language's hashes that holds the wanted number with room to spare, then the exact number
    totals = rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(totals) > MOST_LANGUAGES:
        raise ValueError(f"{lang} has more than {MOST_LANGUAGES} values")
    shares = labelled.sparkSession.createDataFrame([(r["lang"], min(1.0, 2.0 * per_language / r["count"])) for r in totals], "lang string, share double")
    drawn = rows.join(F.broadcast(shares), "lang").filter(F.pmod("h", F.lit(1 << 20)) < F.col("share") * (1 << 20))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    sample = drawn.withColumn("place", place).filter(F.col("place") <= per_language).select("lang", "text")
    counted = sample.mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counted.withColumn("rank", rank).filter(F.col("rank") <= size).select("lang", "rank", "gram")


def _nearest(langs: list[str], codes: np.ndarray, places: np.ndarray, size: int):
    """places: a row a code, a column a language; ``size`` where the profile lacks the code."""

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for text in batch.column(1):
                own = ranked(grams(text.as_py()), size)[0] if text.is_valid and langs else ()
                if not len(own):
                    names.append("und")
                    scores.append(0.0)
                    continue
                at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
                there = np.where((codes[at] == own)[:, None], places[at], size)
                apart = np.where(there == size, size, np.abs(there - np.arange(len(own))[:, None])).sum(axis=0)
                best = int(apart.argmin())
                names.append(langs[best])
                scores.append(float(1 - apart[best] / (size * len(own))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["key", "lang_pred", "score"])

    return predict


def identify(docs: DataFrame, profiles: DataFrame, carry: list[Column], text: str = "text", size: int = PROFILE) -> DataFrame:
    """``carry`` columns, ``lang_pred`` and ``score`` for every row. The profiles, ``size`` rows a
    language, go to every task."""
    rows = profiles.orderBy("lang", "rank").toPandas()
    langs = sorted(rows["lang"].unique())
    codes = np.unique(rows["gram"].to_numpy(np.int64))
    places = np.full((len(codes), len(langs)), size, np.int64)
    places[np.searchsorted(codes, rows["gram"].to_numpy(np.int64)), [langs.index(x) for x in rows["lang"]]] = rows["rank"] - 1
    keyed = docs.select(F.struct(*carry).alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = f"key {keyed.schema['key'].dataType.simpleString()}, lang_pred string, score double"
    return keyed.mapInArrow(_nearest(langs, codes, places, size), schema).select("key.*", "lang_pred", "score")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(as_long("doc_id").alias("doc_id"), "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out")
    profiles = written(learn(docs.filter(~held_out)), "language-profiles")
    return identify(docs, profiles, [F.col("doc_id"), held_out])
