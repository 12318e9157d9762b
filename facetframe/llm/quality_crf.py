"""Document quality by a linear-chain conditional random field over lines: marginals of 'good', weighted by length."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_sample, held_out, labelled_texts, small_batches, table

#: Bounds of the labelled rows that the field is fitted on: so many whole texts, of so many lines in all.
TRAIN_ROWS, TRAIN_LINES = 4000, 400_000
#: Lines (with padding) of the chains that are worked on together.
GROUP_LINES = 40_000
STEPS, RATE, RIDGE = 150, 0.08, 1e-3
WORD = re.compile(r"\S+")
SYMBOLS, STOPS = "#*$%&|<>{}[]\\^~=", ".,;:?"
OWN = 11


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each line that has a word, and the lines' lengths. Neighbours' features stand beside a line's own."""
    rows, sizes, seen_lines, seen_words = [], [], set(), set()
    total = 0
    for line in (text or "").split("\n"):
        words = WORD.findall(line)
        if not words:
            continue
        n, c = len(words), len(line)
        letters = sum(map(len, words))
        upper = sum(w.isupper() for w in words)
        old = sum(w in seen_words for w in words)
        rows.append((
            min(1.0, sum(map(line.count, SYMBOLS)) / n), min(1.0, line.count("!") / n), upper / n, min(1.0, sum(map(line.count, "0123456789")) / letters * 4),
            1 - len(set(words)) / n, old / n, float(line in seen_lines), min(1.0, sum(map(line.count, STOPS)) / n * 3), min(1.0, letters / n / 12), float(n < 4), float(line.rstrip()[-1:] in ".?\"'"),
        ))
        seen_lines.add(line)
        seen_words.update(words)
        sizes.append(c)
        total += n
    if not rows:
        return np.zeros((0, 3 * OWN + 2)), np.zeros(0)
    own = np.array(rows)
    before, after = np.vstack([own[:1] * 0, own[:-1]]), np.vstack([own[1:], own[:1] * 0])
    short = np.full((len(own), 1), float(total < 40))
    return np.hstack([own, before, after, short, np.ones((len(own), 1))]), np.array(sizes, float)


def _chain(unary: np.ndarray, pair: np.ndarray, lengths: np.ndarray, share: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over chains padded to one length: unary (docs, lines, 2). Marginals, expected transitions (each chain's times its share) and the sum of log Z."""
    n, m, _ = unary.shape
    at = np.arange(m)[None, :] < lengths[:, None]
    alpha, beta = np.zeros_like(unary), np.zeros_like(unary)
    alpha[:, 0] = unary[:, 0]
    for t in range(1, m):
        step = np.logaddexp(alpha[:, t - 1, :1] + pair[0], alpha[:, t - 1, 1:] + pair[1]) + unary[:, t]
        alpha[:, t] = np.where(at[:, t, None], step, alpha[:, t - 1])
    for t in range(m - 2, -1, -1):
        right = unary[:, t + 1] + beta[:, t + 1]
        step = np.logaddexp(right[:, :1] + pair[:, 0], right[:, 1:] + pair[:, 1])
        beta[:, t] = np.where(at[:, t + 1, None], step, beta[:, t + 1])
    z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    marginal = np.exp(alpha + beta - z[:, None, None]) * at[:, :, None]
    moves = np.zeros((2, 2))
    if m > 1:
        for a in (0, 1):
            for b in (0, 1):
                each = (np.exp(alpha[:, :-1, a] + pair[a, b] + unary[:, 1:, b] + beta[:, 1:, b] - z[:, None]) * at[:, 1:]).sum(axis=1)
                moves[a, b] = each.sum() if share is None else each @ share
    return marginal, moves, float(z.sum())


class Field:
    """weights: of a line's features for 'good'; pair[a, b]: of label b after a (0 bad, 1 good)."""

    def __init__(self, width: int = 3 * OWN + 2):
        self.weights, self.pair = np.zeros(width), np.zeros((2, 2))

    def quality(self, text: str | None) -> float:
        x, sizes = line_features(text)
        if not len(x):
            return 0.0
        unary = np.zeros((1, len(x), 2))
        unary[0, :, 1] = x @ self.weights
        marginal, _, _ = _chain(unary, self.pair, np.array([len(x)]))
        return float((marginal[0, :, 1] * sizes).sum() / sizes.sum())


def fit(labelled: DataFrame, text: str = "text", quality: str = "quality", rows: int = TRAIN_ROWS, lines: int = TRAIN_LINES) -> Field:
    """labelled: texts with quality 0 or 1. Each line takes its text's label.

    Fitted on at most `rows` texts chosen by hash, and of these on as many whole ones as have `lines` lines in all.
    Features come from Spark; conditional likelihood is climbed by Adam, each class with the same weight.
    """
    some = bounded_sample(labelled.withColumns({"text": F.col(text).cast("string"), "y": F.col(quality).cast("int")}).where("text is not null and y in (0, 1)"), rows).select("text", "y")
    sized = some.select("text", "y", (F.length("text") - F.length(F.translate("text", "\n", "")) + 1).alias("n"), F.xxhash64("text").alias("at"))
    upto = F.sum("n").over(Window.orderBy("at", "n", "y"))  # of at most `rows` rows
    some = sized.withColumn("upto", upto).where(F.col("upto") <= lines).select("text", "y").repartition(8)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [line_features(t)[0].astype(np.float32) for t in batch["text"]]
            yield pd.DataFrame({"x": [m.tobytes() for m in made], "y": batch["y"].to_numpy()})

    found = some.mapInPandas(features, "x binary, y int").toPandas().sort_values(["y", "x"])
    field = Field()
    width = len(field.weights)
    docs = [(np.frombuffer(x, np.float32).reshape(-1, width), y) for x, y in zip(found["x"], found["y"]) if len(x)]
    good = sum(y for _, y in docs)
    if not docs or good in (0, len(docs)):
        return field
    groups = []
    for label, share in ((0, 0.5 / (len(docs) - good)), (1, 0.5 / good)):
        own = sorted((x for x, y in docs if y == label), key=len)
        while own:  # chains of like lengths together, fewer of them where they are long
            part = own[-max(1, min(400, GROUP_LINES // len(own[-1]))) :]
            del own[-len(part) :]
            x, n = np.zeros((len(part), len(part[-1]), width)), np.array([len(p) for p in part])
            for i, p in enumerate(part):
                x[i, : len(p)] = p
            groups.append((x.reshape(-1, width), n, label, share / n))
    w, pair = field.weights, field.pair
    m1, m2 = np.zeros(width + 4), np.zeros(width + 4)
    for step in range(1, STEPS + 1):
        gw, gp = -RIDGE * w, -RIDGE * pair
        for x, n, label, share in groups:
            unary = np.zeros((len(n), len(x) // len(n), 2))
            unary[:, :, 1] = (x @ w).reshape(len(n), -1)
            at = np.arange(unary.shape[1])[None, :] < n[:, None]
            marginal, moves, _ = _chain(unary, pair, n, share)
            gw = gw + ((at * label - marginal[:, :, 1]) * share[:, None]).reshape(-1) @ x
            gp = gp - moves
            gp[label, label] += (n - 1) @ share
        g = np.concatenate([gw, gp.reshape(-1)])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        move = RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        w, pair = w + move[:width], pair + move[width:].reshape(2, 2)
    field.weights, field.pair = w, pair
    return field


def score_quality(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """docs with `quality_score` double, 0 to 1: the share of the text's characters in good lines, by marginals.

    Null texts and texts without words score 0. Every line of a long text counts. Repeated rows are scored alike; an
    empty table gives an empty result. An input column `quality_score` is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)  # a few dozen weights
    return small_batches(docs).withColumn("quality_score", F.pandas_udf(lambda texts: pd.Series([sent.value.quality(t) for t in texts], dtype=float), "double")(F.col(text).cast("string")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(F.col("doc_id"), 3, 1).alias("held_out"))
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 3, 1))
    field = fit(labelled_texts(docs, labels, "quality", TRAIN_ROWS))
    return score_quality(docs, field).select("doc_id", "held_out", F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))
