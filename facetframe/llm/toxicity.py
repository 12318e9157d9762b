"""Toxicity by a weighted lexicon that Aho-Corasick finds in folded text; exception phrases don't count, length normalises."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, held_out, labelled_texts, small_batches, table

#: Bound of the labelled rows that the lexicon is learned from. What it holds is bounded by them: each entry and each exception is in at least MIN_TEXTS of them.
TRAIN_ROWS = 8000
#: An entry is in at least so many toxic training texts, and its odds to be toxic are at least so many times those of any text.
MIN_TEXTS, MIN_LIFT = 4, 8.0
PREFIXES = range(4, 9)

#: Letters that look like Latin ones, digits and signs used for letters.
HOMOGLYPHS = dict(zip("авсеһіјкмнорԛѕтухԝѡαβεικνορτυχ", "abcehijkmhopqstyxwwabeiknoptux"))
SUBSTITUTES = dict(zip("01345789@$", "oieastbgas"))
_signs = {ord(k): v for k, v in (HOMOGLYPHS | SUBSTITUTES).items()}
WORD = re.compile(r"[^\W_]+")
_plain = re.compile(r"^[a-zß-öø-ÿ\s.,;:?!#*%&'\"()<>|/=+_\-]*$")


def fold(text: str) -> str:
    """Lower case, one form of each character, homoglyphs as Latin letters, digits and signs inside words as letters; length may change."""
    text = text.lower()
    if _plain.match(text):
        return text
    text = unicodedata.normalize("NFKC", text)
    return WORD_SIGNS.sub(lambda m: m[0] if m[0].isdigit() else m[0].translate(_signs), text)


WORD_SIGNS = re.compile(r"[\w@$]*[\d@$Ͱ-ϿЀ-ԯ][\w@$]*")


def phrases_at(folded: str, start: int, entry: str) -> list[tuple[str, str]]:
    """(word before, entry) and (entry, word after) of a hit whose word begins at `start`, however far off those words are."""
    found, end = [], start
    while end and not folded[end - 1].isalnum():
        end -= 1
    at = end
    while at and folded[at - 1].isalnum():
        at -= 1
    if at < end:
        found.append((folded[at:end], entry))
    own = WORD.match(folded, start)
    after = WORD.search(folded, own.end() if own else start)
    if after:
        found.append((entry, after[0]))
    return found


class Lexicon:
    """entries: text → weight, found where a word begins; exceptions: (word before, entry) and (entry, word after) pairs that don't count."""

    def __init__(self, entries: dict[str, float], exceptions: set[tuple[str, str]] = frozenset(), fit: tuple[float, ...] = (-3.0, 3.0, 1.0)):
        self.entries, self.exceptions, self.fit = entries, exceptions, fit
        self._machine = None

    def __getstate__(self):
        return self.__dict__ | {"_machine": None}

    @property
    def machine(self):
        if self._machine is None:
            self._machine = ahocorasick.Automaton()
            for e, w in self.entries.items():
                self._machine.add_word(e, (e, w))
            if self.entries:
                self._machine.make_automaton()
        return self._machine

    def hits(self, folded: str) -> list[tuple[int, str, float]]:
        """(start, entry, weight): of the entries that begin at a word's start, the longest."""
        best: dict[int, tuple[str, float]] = {}
        if not self.entries:
            return []
        for end, (e, w) in self.machine.iter(folded):
            start = end - len(e) + 1
            if (start == 0 or not folded[start - 1].isalnum()) and len(e) > len(best.get(start, ("", 0))[0]):
                best[start] = (e, w)
        return [(s, e, w) for s, (e, w) in sorted(best.items())]

    def _excused(self, folded: str, start: int, entry: str) -> bool:
        return bool(self.exceptions) and any(phrase in self.exceptions for phrase in phrases_at(folded, start, entry))

    def features(self, text: str | None) -> tuple[float, float]:
        """Weight that counts, in all and per 100 characters, each as a logarithm."""
        folded = fold(text or "")
        total = sum(w for s, e, w in self.hits(folded) if not self._excused(folded, s, e))
        return math.log1p(total), math.log1p(100 * total / max(20, len(folded)))

    def score(self, text: str | None) -> float:
        a, b = self.features(text)
        z = self.fit[0] + self.fit[1] * a + self.fit[2] * b
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (y - p) - 0.01 * b
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(x.shape[1])
        b = b + np.linalg.solve(hess, grad)
    return tuple(float(v) for v in b)


def fit(labelled: DataFrame, text: str = "text", toxic: str = "toxic", rows: int = TRAIN_ROWS) -> Lexicon:
    """labelled: texts with toxic 0 or 1. Learned from at most `rows` of them, chosen by hash; Spark counts the texts that have each word start."""
    spark = labelled.sparkSession
    some = bounded_sample(labelled.withColumns({"text": F.col(text).cast("string"), "toxic": F.col(toxic).cast("int")}).where("text is not null and toxic in (0, 1)"), rows).select("text", "toxic")

    def starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = {0: Counter(), 1: Counter()}
            for t, y in zip(batch["text"], batch["toxic"]):
                words = set(WORD.findall(fold(t)))
                seen[int(y)].update(words | {w[:k] for w in words for k in PREFIXES if len(w) > k})
            keys = [*(seen[0].keys() | seen[1].keys())]
            if keys:
                yield pd.DataFrame({"entry": keys, "t": [seen[1][k] for k in keys], "c": [seen[0][k] for k in keys]})

    sizes = {r.toxic: r["count"] for r in some.groupBy("toxic").count().collect()}
    n_t, n_c = sizes.get(1, 0), sizes.get(0, 0)
    if not n_t or not n_c:
        return Lexicon({}, fit=(-3.0 if n_c else 0.0, 0.0, 0.0))
    odds = F.log((F.col("t") + 0.5) / (n_t + 1) / ((F.col("c") + 0.5) / (n_c + 1)))
    counts = some.mapInPandas(starts, "entry string, t long, c long").groupBy("entry").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where(f"t >= {MIN_TEXTS}").withColumn("w", odds).where(F.col("w") >= math.log(MIN_LIFT))
    found = counts.where(F.col("t") * n_c >= F.col("c") * n_t * MIN_LIFT).orderBy(F.desc("t"), F.length("entry"), "entry").collect()
    by = {r.entry: r for r in found}
    children: dict[str, list[str]] = defaultdict(list)
    for x in by:
        for k in range(1, len(x)):
            children[x[:k]].append(x)
    entries: dict[str, float] = {}
    for r in found:  # of prefixes that find about the same texts the longest one stays
        longer = [x for x in children[r.entry] if by[x].t >= 0.9 * r.t]
        if longer:
            continue
        if any(r.entry[:k] in entries for k in range(min(PREFIXES), len(r.entry))):
            continue  # a shorter entry with more texts is in already
        entries[r.entry] = float(r.w)
    raw = Lexicon(entries)
    sent = spark.sparkContext.broadcast(raw)

    def phrases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = {0: Counter(), 1: Counter()}
            for t, y in zip(batch["text"], batch["toxic"]):
                folded, own = fold(t), set()
                for s, e, _ in sent.value.hits(folded):
                    own.update(phrases_at(folded, s, e))
                seen[int(y)].update(own)
            keys = [*(seen[0].keys() | seen[1].keys())]
            if keys:
                yield pd.DataFrame({"a": [k[0] for k in keys], "b": [k[1] for k in keys], "t": [seen[1][k] for k in keys], "c": [seen[0][k] for k in keys]})

    excused = some.mapInPandas(phrases, "a string, b string, t long, c long").groupBy("a", "b").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where(f"c >= {MIN_TEXTS} and c * {n_t} > 4 * t * {n_c}").collect()
    lexicon = Lexicon(entries, {(r.a, r.b) for r in excused})
    again = spark.sparkContext.broadcast(lexicon)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            both = [again.value.features(t) for t in batch["text"]]
            yield pd.DataFrame({"a": [x[0] for x in both], "b": [x[1] for x in both], "y": batch["toxic"]})

    points = some.mapInPandas(features, "a double, b double, y int").toPandas().sort_values(["a", "b", "y"])
    lexicon.fit = _logistic(points[["a", "b"]].to_numpy(), points["y"].to_numpy(float))
    return lexicon


def score_toxicity(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """docs with `toxicity` double, 0 to 1.

    Null and empty texts get the score of a text without hits. Repeated rows are scored alike; an empty table gives an
    empty result. An input column `toxicity` is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)  # bounded by the rows that it was learned from
    return small_batches(docs).withColumn("toxicity", F.pandas_udf(lambda texts: pd.Series([sent.value.score(t) for t in texts], dtype=float), "double")(F.col(text).cast("string")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(F.col("doc_id"), 5, 0).alias("held_out"))
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 5, 0))
    lexicon = fit(labelled_texts(docs, labels, "toxic", TRAIN_ROWS))
    return score_toxicity(docs, lexicon).select("doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
