"""Whole objects of bounded size, many at once in a task: one shuffle brings an object's rows together, numpy works on all of them.

Batches are data frames sorted by object; `code` numbers the objects of a batch from 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a batch has at least, unless there are no more.
ROWS = 50_000
#: Rows that a task has about, at most, where a table is dealt by object.
TASK_ROWS = 1_000_000


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """rows in as many partitions by keys as n rows need, so that a task's memory does not grow with the table. Few rows are left as they are: Spark deals those well.

    Beyond spark.shuffle.sort.bypassMergeThreshold partitions Spark sorts what a task writes, in memory; up to twice TASK_ROWS are taken to stay below that.
    """
    spark = rows.sparkSession
    unsorted = int(spark.sparkContext.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    tasks = max(min(-(-n // TASK_ROWS), unsorted), -(-n // (2 * TASK_ROWS)))
    return rows.repartition(tasks, *keys) if tasks > min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))) else rows


def whole(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], work: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """work(rows of whole objects, code) over all objects; keys name an object, order sorts its rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n, enough = [], 0, ROWS
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= enough:
                pdf = pd.concat(held, ignore_index=True)
                code = codes(pdf, keys)
                cut = int(np.searchsorted(code, code[-1]))
                if cut:
                    yield from _plain(work(pdf.iloc[:cut], code[:cut]))
                held, n = [pdf.iloc[cut:].reset_index(drop=True)], n - cut
                enough = max(ROWS, 2 * n)
        if n:
            pdf = pd.concat(held, ignore_index=True)
            yield from _plain(work(pdf, codes(pdf, keys)))

    return together(rows, keys, order).mapInPandas(run, schema)


def together(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """rows of an object in one task, sorted. A window asks for the same as a shuffle and a sort, but rows that already lie by their only key stay where they are. Rows that lie by some of several keys would come in few tasks, so those are shuffled.

    A shuffle by just these keys is left out by Spark where rows, or all parts of a union, seem to lie by them already; as no operator then
    asks for it, they may be read in another way in the end, so a constant is among the keys.
    """
    if len(keys) > 1:
        return rows.repartition(*keys, F.lit(0)).sortWithinPartitions(*keys, *order)
    return rows.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_at > 0").drop("_at")


def _plain(made: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Not an empty frame, and no texts in chunks of Arrow, which are no single array on the way back."""
    if len(made):
        yield made.astype({c: object for c in made.columns if not isinstance(made[c].dtype, np.dtype)})


def codes(pdf: pd.DataFrame, keys: tuple[str, ...]) -> np.ndarray:
    new = np.zeros(len(pdf), bool)
    for k in keys:
        a, none = pdf[k].to_numpy(), pdf[k].isna().to_numpy()
        new[1:] |= (a[1:] != a[:-1]) & ~(none[1:] & none[:-1])
    return np.cumsum(new)


def numbered(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 of the rows of some columns of integers, in the rows' order, and the first row of each."""
    key, most = np.zeros(len(columns[0]), np.int64), 1
    for c in columns:
        low = int(c.min(initial=0))
        span = int(c.max(initial=0)) - low + 1
        if most * span >= 2**62:
            key = np.unique(key, return_inverse=True)[1]
            most = len(key) + 1
        if most * span >= 2**62:
            c = np.unique(c, return_inverse=True)[1]
            low, span = 0, len(c) + 1
        key, most = key * span + (c - low), most * span
    _, first, number = np.unique(key, return_index=True, return_inverse=True)
    return number, first


def sides(code: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and edge number of all first sides, all second and all third ones of triangles v (n, 3)."""
    s, e = v.T.ravel(), v[:, [1, 2, 0]].T.ravel()
    return s, e, numbered(np.tile(code, 3), np.minimum(s, e), np.maximum(s, e))[0]


def least_labels(node: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of n nodes is connected with by groups."""
    label, groups = np.arange(n), int(group.max(initial=-1)) + 1
    while True:
        least = np.full(groups, n)
        np.minimum.at(least, group, label[node])
        after = label.copy()
        np.minimum.at(after, node, least[group])
        after = after[after]
        if (after == label).all():
            return label
        label = after


def places(code: np.ndarray, v: np.ndarray, of: np.ndarray, vid: np.ndarray) -> np.ndarray:
    """Rows of the vertices (of: their object's code, vid) that v of objects `code` name; -1 where there is none."""
    number, _ = numbered(np.concatenate([of, code]), np.concatenate([vid, v]))
    at = np.full(int(number.max(initial=-1)) + 1, -1)
    at[number[: len(of)]] = np.arange(len(of))
    return at[number[len(of) :]]


def pairs(code: np.ndarray, most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of one object, the earlier first, about `most` at a time."""
    later = np.searchsorted(code, code, side="right") - np.arange(len(code)) - 1
    ends = np.cumsum(later)
    begin = 0
    while begin < len(code):
        base = ends[begin] - later[begin]
        end = max(begin + 1, int(np.searchsorted(ends, base + most, side="right")))
        n = later[begin:end]
        a = np.repeat(np.arange(begin, end), n)
        yield a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        begin = end
