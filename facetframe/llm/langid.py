"""Language identification: a bit-sliced Bloom filter returns all languages that contain an n-gram; corrected counts per language decide."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, held_out, small_batches, table

SIZES = (3, 4)
PROBES = 2
#: The filters have at least so many slots, and so many for each n-gram of the language with most of them.
SLOTS, SLOTS_A_GRAM = 1 << 20, 8
#: Bound of the labelled rows of each language that the filters are fitted on; it bounds the n-grams too.
TRAIN_ROWS = 2000
#: A language contains an n-gram that is seen this often in its training texts, at a rate of at least this share of the n-gram's highest rate.
MIN_COUNT, MIN_SHARE = 3, 0.2
UNKNOWN = "und"

@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


def grams(text: str) -> np.ndarray:
    """Hashes of the n-grams of letters of the whole text, lower-cased; anything else is one space, and no n-gram has a space inside."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = np.where(_letters()[c], c, 32)
    if not len(c) or c.max() == 32:
        return np.zeros(0, np.uint64)
    c = np.concatenate([[32], c, [32]])
    c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])].astype(np.uint64)
    out = []
    space = c == 32
    for n in SIZES:
        if len(c) < n:
            continue
        h = np.full(len(c) - n + 1, n, np.uint64)
        inner = np.zeros(len(h), bool)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + c[k : len(c) - n + 1 + k]
            if 0 < k < n - 1:
                inner |= space[k : len(c) - n + 1 + k]
        out.append(_mix(h[~inner]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _places(h: np.ndarray, slots: int) -> list[np.ndarray]:
    """slots: a power of two, 2^32 at most."""
    return [((h >> np.uint64(32 * k)) & np.uint64(slots - 1)).astype(np.int64) for k in range(PROBES)]


class Filters:
    """For each bit of the Bloom filters a mask of the languages whose filter has it set, 64 languages to a table."""

    def __init__(self, languages: list[str], hashes: np.ndarray, of: np.ndarray):
        self.languages = languages
        most = int(np.bincount(of, minlength=1).max()) if len(of) else 0
        self.slots = max(SLOTS, 1 << (SLOTS_A_GRAM * most - 1).bit_length() if most else 0)
        self.tables = []
        for base in range(0, max(1, len(languages)), 64):
            t = np.zeros(self.slots, np.uint64)
            own = (of >= base) & (of < base + 64)
            for place in _places(hashes[own], self.slots):
                np.bitwise_or.at(t, place, np.uint64(1) << (of[own] - base).astype(np.uint64))
            self.tables.append(t)
        self.false = np.array([((t >> np.uint64(b)) & np.uint64(1)).mean() ** PROBES for t in self.tables for b in range(64)])[: len(languages)]

    def counts(self, h: np.ndarray) -> np.ndarray:
        """N-grams of each language, less the false positives that its filter's fill leads to expect."""
        places = _places(h, self.slots)
        out = []
        for t in self.tables:
            mask = t[places[0]]
            for p in places[1:]:
                mask = mask & t[p]
            out += [np.count_nonzero(mask & (np.uint64(1) << np.uint64(b))) for b in range(min(64, len(self.languages) - len(out)))]
        return (np.array(out) - len(h) * self.false) / (1 - self.false)

    def judge(self, text: str | None) -> tuple[str, float]:
        h = grams(text or "")
        if not len(h) or not self.languages:
            return UNKNOWN, 0.0
        c = np.maximum(self.counts(h), 0)
        best = int(np.argmax(c))
        if c[best] <= 0:
            return self.languages[0], 0.0
        return self.languages[best], float(np.clip((c[best] - np.max(np.delete(c, best), initial=0.0)) / c[best], 0, 1))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> Filters:
    """labelled: texts with a non-null language. Fitted on at most `rows` texts of each language, chosen by a hash of all columns, however frequent the others are; n-grams are counted by Spark."""
    on = [F.col(f"`{c}`") for c, kind in labelled.dtypes if "map<" not in kind and kind != "variant"]
    known = labelled.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), F.pmod(F.xxhash64(*on, F.lit(17)), F.lit(1 << 31)).alias("at")).where("text is not null and lang is not null")
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}  # a number for each language, as the filters have
    most = labelled.sparkSession.createDataFrame([(x, int(min(1.0, 0.9 * rows / n) * (1 << 31)) if n > rows else 1 << 31) for x, n in sizes.items()], "l string, most long")
    some = known.join(F.broadcast(most), (F.col("lang") == F.col("l")) & (F.col("at") < F.col("most"))).select("text", "lang").limit(rows * max(1, len(sizes)))
    some = checkpointed(some.repartition(8, "text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, part in batch.groupby("lang"):
                h, n = np.unique(np.concatenate([grams(t) for t in part["text"]]), return_counts=True)
                yield pd.DataFrame({"lang": name, "h": h.view(np.int64), "n": n})

    counts = some.mapInPandas(count, "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rate = counts.where(f"n >= {MIN_COUNT}").join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total"))
    top = rate.groupBy("h").agg(F.max("rate").alias("top"))
    kept = rate.join(top, "h").where(F.col("rate") >= MIN_SHARE * F.col("top")).select("lang", "h").toPandas()  # bounded by the sample
    seen = {r.lang: r.total for r in totals.collect()}
    languages = sorted(seen, key=lambda x: (-seen[x], x))
    of = kept["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(np.int64) if len(kept) else np.zeros(0, np.int64)
    return Filters(languages, kept["h"].to_numpy(np.int64).view(np.uint64) if len(kept) else np.zeros(0, np.uint64), of)


def identify(docs: DataFrame, filters: Filters, text: str = "text") -> DataFrame:
    """docs with `language` struct(lang_pred, score): the language with most n-grams and its lead over the next one (0 to 1).

    `und` with score 0 for a null text or one without letters, and where nothing was learned; the most common language
    with score 0 where no n-gram is known. Ties go to the more common language. Repeated rows are judged alike; an empty
    table gives an empty result. An input column `language` is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(filters)  # 8 bytes a slot for each 64 languages, bounded by the sample

    def judge(texts: pd.Series) -> pd.DataFrame:
        f = sent.value
        return pd.DataFrame([f.judge(t) for t in texts], columns=["lang_pred", "score"])

    return small_batches(docs).withColumn("language", F.pandas_udf(judge, "lang_pred string, score double")(F.col(text).cast("string")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out(F.col("doc_id"), 5, 0).alias("held_out"))
    filters = fit(docs.where("not held_out"))
    return identify(docs.drop("lang"), filters).select("doc_id", "held_out", "language.lang_pred", "language.score")
