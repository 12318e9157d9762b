"""Benchmark decontamination: an FM-index over the words of each training shard answers the test phrases by backward search."""

from __future__ import annotations

import functools
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, give_back, small_batches, table, text_key

WINDOW = 10
#: As in lower-cased text, but found before lower-casing, so that places in the text stay what they are.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
#: Bytes of the benchmark's text that a worker holds at a time (its windows take about 60 MB), and bytes of text that one index covers at least.
BLOCK_BYTES, SHARD_CHARS = 4_000_000, 8_000_000
#: Every so many-th place of the text is kept in the index.
SAMPLED = 8


def words_of(text: str) -> list[str]:
    return [w.translate(LOWER) if not w.islower() else w for w in WORD.findall(text)]


class WaveletMatrix:
    """Rank over a sequence of symbols, a bit vector for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.bits, self.zeros, self.ones = max(1, int(top).bit_length()), [], []
        for level in reversed(range(self.bits)):
            bit = (symbols >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(len(symbols) - int(self.ones[-1][-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        self.first = self._walk(np.arange(top + 1), np.zeros(top + 1, dtype=np.int64))

    def _walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(reversed(range(self.bits))):
            ones = self.ones[k][at]
            at = np.where((symbols >> level) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        return self._walk(symbols, at) - self.first[symbols]


class FMIndex:
    """Index of a sequence of symbols in which 0 separates runs; each separator sorts by its own place."""

    def __init__(self, text: np.ndarray, top: int):
        n = len(text)
        separators = text == 0
        n_sep = int(separators.sum())
        rank = np.where(separators, np.cumsum(separators) - 1, text + (n_sep - 1)).astype(np.int64)
        order, step = np.argsort(rank, kind="stable"), 1
        while True:  # prefix doubling; a run ends in a separator of its own, so it stops by the longest run
            key = rank * (n + n_sep + int(top) + 1)
            key[:-step] += rank[step:] + 1
            order = np.argsort(key)
            found = key[order]
            new = np.empty(n, dtype=np.int64)
            new[order] = np.concatenate([[0], np.cumsum(found[1:] != found[:-1])])
            rank, step = new, step * 2
            if rank[order[-1]] == n - 1 or step >= n:
                break
        self.bwt = text[order - 1]
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.matrix = WaveletMatrix(self.bwt, top)
        kept = (order % SAMPLED == 0) | (self.bwt == 0)  # the first word of each run too: a walk to the left never leaves its run
        self.kept_before = np.concatenate([[0], np.cumsum(kept)])
        self.kept, self.places, self.n = kept, order[kept], n

    def _left(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.counts[symbols] + self.matrix.rank(symbols, at)

    def ranges(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each phrase (a row of `phrases`)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in reversed(range(phrases.shape[1])):
            c = phrases[live, k]
            low[live], high[live] = self._left(c, low[live]), self._left(c, high[live])
            live = live[low[live] < high[live]]
        high = np.maximum(low, high)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Place in the text of each suffix, by steps to the left to one whose place is kept."""
        out, walked, live = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        rows = rows.copy()
        while len(live):
            done = self.kept[rows[live]]
            got = live[done]
            out[got] = self.places[self.kept_before[rows[got]]] + walked[got]
            live = live[~done]
            rows[live] = self._left(self.bwt[rows[live]], rows[live])
            walked[live] += 1
        return out


class Phrases:
    """Distinct windows of benchmark items as word numbers, with the items of each. groups: for each length (windows, edges, owners): the w-th window's items are owners[edges[w] : edges[w + 1]]."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.vocabulary: dict[str, int] = {}
        self.ids, by_size = [i for i, _ in items], {}
        for k, (_, text) in enumerate(items):
            at = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text or "")], dtype=np.int32)
            if len(at):
                rows = np.lib.stride_tricks.sliding_window_view(at, min(window, len(at)))
                by_size.setdefault(rows.shape[1], []).append((rows, np.full(len(rows), k, dtype=np.int32)))
        self.groups = []
        for size in sorted(by_size):
            rows, owner = (np.concatenate(x) for x in zip(*by_size.pop(size)))
            rows, which = np.unique(rows, axis=0, return_inverse=True)
            pairs = np.unique(which.reshape(-1).astype(np.int64) * len(self.ids) + owner)
            self.groups.append((rows, np.searchsorted(pairs // len(self.ids), np.arange(len(rows) + 1)), (pairs % len(self.ids)).astype(np.int32)))
        self.shortest = self.groups[0][0].shape[1] if self.groups else 0


_built: dict[str, Phrases] = {}


def _phrases(token: str, sent) -> Phrases:
    """The phrases of a broadcast block, which each worker builds once; those of one block at a time are kept."""
    if token not in _built:
        _built.clear()
        _built[token] = Phrases(sent.value)
    return _built[token]


def _search(numbers: list[np.ndarray], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, list[set]]:
    """For texts as word numbers (0: no benchmark word), whether each word of their concatenation is hit, its text's edges, the items of each text."""
    edges = np.cumsum([0, *[len(x) + 1 for x in numbers]])
    words = np.zeros(int(edges[-1]), dtype=np.int64)
    for x, e in zip(numbers, edges):
        words[e : e + len(x)] = x
    hit, items = np.zeros(len(words) + 1, dtype=np.int32), [set() for _ in numbers]
    known = np.concatenate([[0], (words > 0).astype(np.int8), [0]])
    starts, ends = np.flatnonzero(np.diff(known) == 1), np.flatnonzero(np.diff(known) == -1)
    long = (ends - starts) >= phrases.shortest
    starts, ends = starts[long], ends[long]
    if len(starts) and phrases.groups:
        sizes = ends - starts + 1  # with a separator
        before = np.cumsum(sizes) - sizes
        origin = np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))
        text = words[np.minimum(origin, len(words) - 1)]
        text[before + sizes - 1] = 0
        index = FMIndex(text, len(phrases.vocabulary))
        for rows, edge, owners in phrases.groups:
            low, high = index.ranges(rows)
            found = np.flatnonzero(high > low)
            many = (high - low)[found]
            if not len(found):
                continue
            flat = np.repeat(low[found] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            at = origin[index.locate(flat)]
            np.add.at(hit, at, 1)
            np.add.at(hit, at + rows.shape[1], -1)
            doc = np.searchsorted(edges, at, side="right") - 1
            for d, p in np.unique(np.column_stack([doc, np.repeat(found, many)]), axis=0).tolist():
                items[d].update(owners[edge[p] : edge[p + 1]].tolist())
    return np.cumsum(hit)[:-1] > 0, edges, items


KIND = "n_words long, n_hit long, item_ids array<string>, spans array<struct<start:int,end:int>>, clean string"
_KINDS = (("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("clean", pa.string()))


def _with(batch: pa.RecordBatch, drop: tuple[str, ...], found: list[tuple]) -> pa.RecordBatch:
    """batch without some columns and with what was found of each text."""
    names = [n for n in batch.schema.names if n not in drop]
    made = list(zip(*found)) if found else [()] * len(_KINDS)
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(pa.array(list(x), kind) for x, (_, kind) in zip(made, _KINDS))], [*names, *(n for n, _ in _KINDS)])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have SHARD_CHARS bytes of text: what one index covers."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column("text").nbytes
        if size >= SHARD_CHARS:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _judged(text: str, own: np.ndarray, items: list[str], with_clean: bool) -> tuple:
    """What KIND says of a text whose words are hit as `own` says."""
    n, spans = int(own.sum()), []
    if n:
        places = [m.span() for m in WORD.finditer(text)]
        turn = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
        spans = [(places[a][0], places[b - 1][1]) for a, b in zip(turn[::2].tolist(), turn[1::2].tolist())]
    return len(own), n, items, [{"start": a, "end": b} for a, b in spans], _without(text, spans) if with_clean and n else None


def _scan(token: str, sent, with_clean: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = _phrases(token, sent)

        class Seen(dict):
            def __missing__(self, w):
                self[w] = n = phrases.vocabulary.get(w.translate(LOWER), 0)
                return n

        seen = Seen()
        for batch in _shards(batches):
            texts, numbers = [t or "" for t in batch.column("text").to_pylist()], []
            for t in texts:
                ws = WORD.findall(t)
                numbers.append(np.fromiter(map(seen.__getitem__, ws), np.int64, len(ws)))
                if len(seen) > 300_000:
                    seen.clear()
            hits, at, items = _search(numbers, phrases)
            names = [sorted({phrases.ids[i] for i in own} - {None}) for own in items]
            yield _with(batch, ("text",), [_judged(t, hits[at[k] : at[k + 1] - 1], names[k], with_clean) for k, t in enumerate(texts)])
        seen.clear()
        give_back()

    return scan


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return "".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", with_clean: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, columns `keep`, n_words, n_hit, item_ids, spans and, with with_clean, clean (the text without its spans; null where nothing is hit).

    Windows are 10 words of an item, or the whole of a shorter one; spans are merged and count characters. A null text
    has no words, an item without words no windows; an item with a null id has windows, but is not listed. Repeated rows are scanned alike; an empty table or benchmark gives
    no hits. The benchmark's size is measured: up to BLOCK_BYTES it is broadcast, beyond that documents are scanned
    block by block and the blocks' hits are merged by text.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    rows = docs.select(F.col(doc_id).alias("doc_id"), *[F.col(c) for c in keep], F.col(text).cast("string").alias("text"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    blocks = max(1, -(-total // BLOCK_BYTES))

    def scan(block: int, clean: bool):
        some = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        return _scan(uuid.uuid4().hex, spark.sparkContext.broadcast([(r.item, r.text) for r in some.collect()]), clean)  # about BLOCK_BYTES

    if blocks == 1:
        return small_batches(rows).mapInArrow(scan(0, with_clean), f"{head}, {KIND}")
    distinct = checkpointed(rows.select(text_key(F.col("text")).alias("key"), "text").where("text is not null").dropDuplicates(["key"]))
    parts = [checkpointed(small_batches(distinct).mapInArrow(scan(b, False), f"key binary, {KIND}").where("n_hit > 0").select("key", "item_ids", "spans")) for b in range(blocks)]
    found = functools.reduce(DataFrame.unionByName, parts)
    merged = found.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("all_items"), F.flatten(F.collect_list("spans")).alias("all_spans"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, got, spans in zip(*(batch.column(c).to_pylist() for c in ("text", "all_items", "all_spans"))):
                t, spans = t or "", spans or []
                places = np.array([m.span() for m in WORD.finditer(t)], np.int64).reshape(-1, 2)
                change = np.zeros(len(places) + 1, np.int64)
                np.add.at(change, np.searchsorted(places[:, 0], [x["start"] for x in spans]), 1)
                np.add.at(change, np.searchsorted(places[:, 1], [x["end"] for x in spans]) + 1, -1)
                out.append(_judged(t, np.cumsum(change)[:-1] > 0, got or [], with_clean))
            yield _with(batch, ("text", "all_items", "all_spans"), out)

    joined = rows.withColumn("key", text_key(F.col("text"))).join(merged, "key", "left").drop("key")
    return small_batches(joined).mapInArrow(finish, f"{head}, {KIND}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", F.array_sort("item_ids")).cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
p AS (SELECT item, ws, least(10, len(ws)) AS n, unnest(range(1, greatest(2, len(ws) - 8))) AS k FROM i WHERE len(ws) > 0),
w AS (SELECT DISTINCT item, n, list_slice(ws, k, k + n - 1) AS win FROM p),
sizes AS (SELECT DISTINCT n FROM w),
x AS (SELECT rid, sizes.n, ws, unnest(range(1, len(ws) - sizes.n + 2)) AS k FROM d, sizes WHERE len(ws) >= sizes.n),
g AS (SELECT rid, n, k, list_slice(ws, k, k + n - 1) AS win FROM x),
h AS (SELECT g.rid, g.n, g.k, w.item FROM g JOIN w ON g.n = w.n AND g.win = w.win),
c AS (SELECT rid, count(DISTINCT k + o) AS n_hit FROM (SELECT rid, k, unnest(range(0, n)) AS o FROM h) GROUP BY rid),
t AS (SELECT rid, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
"""
