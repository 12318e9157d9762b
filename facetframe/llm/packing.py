"""Shortest-pack-first packing over the histogram of piece lengths."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, gapless_rank, give_back, small_batches, table

CAPACITY = 2048
#: Rows of the slots' index up to which it is broadcast.
BROADCAST_SLOTS = 1_000_000
END_ID = 1
#: Chunks that a Python worker remembers the ids of, and bytes of text that it cuts at a time.
REMEMBERED, BLOCK_BYTES = 600_000, 4 << 20


class ChunkTokenizer:
    """Ids of texts by a tokenizer that never joins across a space or line break: each different chunk between them is encoded once.

    Arrow splits the texts and finds a block's different chunks among those known. As the tokenizer takes lower case, and
    letters or digits apart from stops after them, 'Word' and 'word,' are known as 'word' and ','.
    """

    #: Stops that are a piece of their own behind what CORE ends in; letters alone are one piece.
    STOPS, CORE, LETTERS = ".,;:!?", r"[0-9A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]$", r"^[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+$"
    #: What must be seen as it stands: special tokens, and marks that join the letter before them.
    AS_IS = r"<\||[\x{300}-\x{36f}]"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        vocabulary = self.inner.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        """known: chunks and stops; the n-th one's ids are ids[starts[n] : starts[n] + lengths[n]]. The empty one has none."""
        self.known = pa.array([""], pa.large_string())
        self.n_ids, self.ids, self.starts, self.lengths = 0, np.zeros(1 << 16, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _learn(self, chunks: pa.Array, words: bool) -> None:
        """words: chunks are one piece each, so the ends of pieces tell them apart; else places in the joined text do."""
        names, counts = chunks.to_pylist(), None
        if words:
            ids = np.array(self.inner.encode_batch_fast([" ".join(names)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids])
            if len(ends) == len(names):
                counts = np.diff(np.concatenate([[-1], ends]))
        if counts is None:
            e = self.inner.encode(" ".join(names), add_special_tokens=False)
            ids, upto = np.array(e.ids, np.uint32), np.cumsum(np.fromiter((len(c) + 1 for c in names), np.int64, len(names)))
            counts = np.bincount(np.searchsorted(upto, np.array([o[0] for o in e.offsets], np.int64), side="right"), minlength=len(names)) if len(names) > 1 else np.array([len(ids)])
        n = self.n_ids + len(ids)
        if n > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.n_ids], np.zeros(n, np.uint32)])
        self.ids[self.n_ids : n] = ids
        self.known = pa.concat_arrays([self.known, chunks])
        self.starts, self.lengths = np.concatenate([self.starts, self.n_ids + np.cumsum(counts) - counts]), np.concatenate([self.lengths, counts])
        self.n_ids = n

    def _learn_new(self, chunks: pa.Array) -> None:
        new = chunks.filter(pc.is_null(pc.index_in(chunks, value_set=self.known)))
        one = pc.match_substring_regex(new, self.LETTERS)
        for part, words in ((new.filter(one), True), (new.filter(pc.invert(one)), False)):
            for i in range(0, len(part), 50_000):
                self._learn(part.slice(i, 50_000), words)

    def _places(self, chunks: pa.Array, as_is: bool) -> np.ndarray:
        """For each chunk the places of its core and of the stops after it."""
        low = pc.ascii_lower(chunks)
        core = pc.utf8_rtrim(low, self.STOPS)
        cut = pc.match_substring_regex(core, self.CORE)
        if as_is:
            plain = pc.invert(pc.match_substring_regex(chunks, self.AS_IS))
            low, cut = pc.if_else(plain, low, chunks), pc.and_(cut, plain)
        core = pc.if_else(cut, core, low)
        begin, size = _edges(low), np.diff(_edges(core))
        left, begin = np.diff(begin) - size, begin[:-1]  # bytes of stops
        upto = np.concatenate([[0], np.cumsum(left)])
        data = np.frombuffer(low.buffers()[2] or b"", np.uint8)[np.repeat(begin + size - upto[:-1], left) + np.arange(int(upto[-1]))]
        stops = pa.LargeStringArray.from_buffers(len(low), pa.py_buffer(upto), pa.py_buffer(data.tobytes())).dictionary_encode()
        core = core.dictionary_encode()
        both = pc.unique(pa.concat_arrays([stops.dictionary, core.dictionary]))
        self._learn_new(both)
        place = lambda x: pc.index_in(x.dictionary, value_set=self.known).to_numpy()[x.indices.to_numpy()]
        return np.column_stack([place(core), place(stops)])

    def encode(self, texts: list[str] | pa.Array, end: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, each text's followed by `end`, and how many each text has (with these). A null text is an empty one."""
        if len(self.known) > REMEMBERED:
            self.clear()
        texts = pc.cast(texts, pa.large_string()) if isinstance(texts, pa.Array | pa.ChunkedArray) else pa.array(texts, pa.large_string())
        texts = pc.replace_substring(pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, ""), "\n", " ")
        split = pc.split_pattern(texts, " ")
        edges = split.offsets.to_numpy().astype(np.int64)
        flat = split.values.slice(edges[0], edges[-1] - edges[0]).dictionary_encode()
        edges -= edges[0]
        at = self._places(flat.dictionary, bool(pc.any(pc.match_substring_regex(texts, self.AS_IS)).as_py()))[flat.indices.to_numpy()].reshape(-1)
        size = self.lengths[at]
        upto = np.concatenate([[0], np.cumsum(size)])
        counts = upto[2 * edges[1:]] - upto[2 * edges[:-1]]
        ids = self.ids[np.repeat(self.starts[at] - upto[:-1], size) + np.arange(int(upto[-1]))]
        if not end:
            return ids, counts
        out = np.empty(len(ids) + len(end) * len(counts), np.uint32)
        out[np.arange(len(ids)) + len(end) * np.repeat(np.arange(len(counts)), counts)] = ids
        after = np.cumsum(counts + len(end))
        for k, i in enumerate(reversed(end), 1):
            out[after - k] = i
        return out, counts + len(end)


def _edges(strings: pa.Array) -> np.ndarray:
    """Where the strings begin in the array's data, and where the last one ends."""
    return np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int64)


_open: dict[str, ChunkTokenizer] = {}


def _tokenizer(path: str) -> ChunkTokenizer:
    if path not in _open:
        _open[path] = ChunkTokenizer(path)
    return _open[path]


def _blocks(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of rows of about `most` bytes each; a row is never cut."""
    turn = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
    edges = [0, *turn.tolist(), len(sizes)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if b > a]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Cut each document's ids (with END_ID after them) into full pieces and a rest: doc_id, start, length, ids_crc32, doc_tokens.

    A null text counts as an empty one, whose only id is END_ID.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(tokenizer)
        for batch in batches:
            for lo, hi in _blocks(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1, BLOCK_BYTES):
                part = batch.slice(lo, hi - lo)
                ids, counts = t.encode(part.column("text"), (END_ID,))
                held, first = memoryview(ids.astype("<u4", copy=False)).cast("B"), np.cumsum(counts) - counts
                n = -(-counts // capacity)
                doc = np.repeat(np.arange(len(counts)), n)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * capacity
                length = np.minimum(capacity, counts[doc] - start)
                at = 4 * (first[doc] + start)
                crcs = np.fromiter((zlib.crc32(held[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist())), np.int64, len(doc))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crcs), pa.array(counts[doc])], names)
        give_back()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return small_batches(rows).mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns and how often each is used. Lengths are placed longest first, each on the emptiest patterns that have room."""
    by_room: dict[int, Counter] = defaultdict(Counter)
    top = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while top and not by_room[top]:
                top -= 1
            if top < length:  # open new packs
                by_room[capacity - length][(length,)] += left
                top = max(top, capacity - length)
                break
            pattern, uses = min(by_room[top].items())
            use = min(left, uses)
            by_room[top][pattern] -= use
            if not by_room[top][pattern]:
                del by_room[top][pattern]
            by_room[top - length][(*pattern, length)] += use
            left -= use
    return sorted((p, n) for room in by_room.values() for p, n in room.items())


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, start, length, ...).

    Only the histogram (at most `capacity` rows) and the plan are on the driver. Each length adds at most two patterns to
    those there are, and a pattern has at most sqrt(2 * capacity) different lengths, so there are at most
    2 * capacity * sqrt(2 * capacity) slots (262,144 for 2048) however many documents there are. Pieces meet slots by
    length and rank. A slot is for all equal lengths of a pattern: `_each` of them side by side in every use.
    """
    cut = checkpointed(cut)
    found = cut.groupBy("length").count().collect()
    spark, slots, taken, first = cut.sparkSession, [], Counter(), 0
    for pattern, uses in plan({r.length: r["count"] for r in found}, capacity):
        offset = 0
        for length, each in sorted(Counter(pattern).items(), reverse=True):
            slots.append((length, taken[length], taken[length] + uses * each, each, first, offset))
            taken[length] += uses * each
            offset += length * each
        first += uses
    ranked = gapless_rank(cut, ["length"], [F.col("doc_id"), F.col("start"), F.col("doc_tokens"), F.col("ids_crc32")], "_rank", sum(r["count"] for r in found))
    columns = ["length", "_from", "_to", "_each", "_first", "_offset"]
    by = spark.createDataFrame(pd.DataFrame(slots, columns=columns).astype("int64"), ", ".join(f"{c} long" for c in columns))
    step = 4096  # slots of one length are found through their block of ranks
    starts = by.withColumnRenamed("length", "_length").withColumn("_block", F.explode(F.sequence(F.expr(f"_from div {step}"), F.expr(f"(_to - 1) div {step}"))))
    if sum((x[2] - 1) // step - x[1] // step + 1 for x in slots) <= BROADCAST_SLOTS:
        starts = F.broadcast(starts)
    ranked = ranked.withColumn("_block", F.expr(f"_rank div {step}"))
    on = (ranked["length"] == starts["_length"]) & (ranked["_block"] == starts["_block"]) & (ranked["_rank"] >= starts["_from"]) & (ranked["_rank"] < starts["_to"])
    n = ranked["_rank"] - starts["_from"]
    return ranked.join(starts, on).select(*[ranked[c] for c in cut.columns], (starts["_first"] + F.floor(n / starts["_each"])).alias("sequence_id"), (starts["_offset"] + n % starts["_each"] * ranked["length"]).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are one piece of one id. A null doc_id is kept; repeated rows get places of their own. An empty
    table gives an empty result; other columns are ignored.
    """
    return pack(pieces(docs, tokenizer, capacity, doc_id, text), capacity)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), default_tokenizer())
