"""Near-duplicates by ProbMinHash: arrivals of a Poisson process for each weighted shingle fill a signature, bands of it propose pairs, the exact probability Jaccard decides."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, give_back, small_batches, table, text_key

WORD = re.compile(r"[^\W_]+")
SHINGLE, SIMILARITY = 5, 0.8
#: At similarity 0.8 a pair shares a band with probability 1 - (1 - 0.8^5)^24 = 0.9999.
BANDS, ROWS = 24, 5
#: Texts on either side of a block of comparisons, and bytes of them; a longer text is a block of its own.
BLOCK, BLOCK_BYTES = 512, 8_000_000
#: Texts that a text is compared with in a turn; comparisons a text at which turns end.
CENTRES, CHEAP = 3, 300
#: A bucket with more comparisons open than this is dealt anew by rare shingles.
MANY = 64 * BLOCK * BLOCK
GOLDEN = 0x9E3779B97F4A7C15
MULTIPLIERS = np.array([(GOLDEN * (2 * i + 1)) % 2**64 | 1 for i in range(8)], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 250_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hashes = _WordHash()


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, count) of the distinct shingles of 5 words, sorted. A text of fewer words, but not none, is one shingle."""
    words, sizes = [], []
    for t in texts:
        w = WORD.findall(t.lower())
        sizes.append(len(w))
        words.append(np.fromiter(map(_hashes.__getitem__, w), np.uint64, len(w)))
    flat, sizes = np.concatenate([*words, np.zeros(SHINGLE, np.uint64)]), np.array(sizes, np.int64)
    ends = np.cumsum(sizes)
    n = np.where(sizes >= SHINGLE, sizes - SHINGLE + 1, (sizes > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(sizes)), n)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ends - sizes, n)
    h = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        inside = at + k < ends[doc]
        h += np.where(inside, _mix(flat[at + k] + MULTIPLIERS[k]), np.uint64(k)) * MULTIPLIERS[k]
    h = _mix(h)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]) if len(doc) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return doc[first], h[first], np.diff(np.concatenate([first, [len(doc)]]))


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, size: int) -> np.ndarray:
    """ProbMinHash: each element's arrivals fall on random components at the rate of its weight; the earliest one names the component.

    An element stops once its last arrival is later than all components of its text.
    """
    earliest, name = np.full(n_docs * size, np.inf), np.zeros(n_docs * size, np.uint64)
    t, rate, turn = np.zeros(len(h)), weight.astype(float), 0
    while len(h):
        turn += 1
        x = _mix(h + np.uint64((GOLDEN * turn) % 2**64))
        t = t - np.log(((x >> np.uint64(11)).astype(float) + 0.5) / 2**53) / rate
        cell = doc * size + (_mix(x + MULTIPLIERS[7]) % np.uint64(size)).astype(np.int64)
        np.minimum.at(earliest, cell, t)
        won = earliest[cell] == t
        name[cell[won]] = h[won]
        live = t < earliest.reshape(-1, size).max(axis=1)[doc]
        doc, h, t, rate = doc[live], h[live], t[live], rate[live]
    return name.reshape(n_docs, size)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two weighted sets given as (sorted hashes, weights)."""
    union = np.union1d(a[0], b[0])
    x, y = np.zeros(len(union)), np.zeros(len(union))
    x[np.searchsorted(union, a[0])], y[np.searchsorted(union, b[0])] = a[1], b[1]
    if not len(union):
        return 0.0
    with np.errstate(divide="ignore"):
        ratio = np.where(x > 0, y / np.where(x > 0, x, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    upto = np.searchsorted(ratio, ratio, side="right")
    below, above = np.concatenate([[0], np.cumsum(x)])[upto], y.sum() - np.concatenate([[0], np.cumsum(y)])[upto]
    both = (x > 0) & (y > 0)
    return float((1 / (below[both] / x[both] + above[both] / y[both])).sum())


def band_keys(docs: DataFrame) -> DataFrame:
    """docs: key, text. Returns (band, key, size), distinct: a row for each band of each text that has a word; size is the text's length."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[~batch["key"].duplicated()]
            for lo in range(0, len(batch), 1000):
                part = batch.iloc[lo : lo + 1000]
                doc, h, n = shingles(part["text"].tolist())
                if not len(doc):
                    continue
                sig = signatures(doc, h, n, len(part), BANDS * ROWS)
                some = np.unique(doc)
                out = np.empty((len(some), BANDS), np.uint64)
                for b in range(BANDS):
                    out[:, b] = _mix((sig[some, b * ROWS : (b + 1) * ROWS] * MULTIPLIERS[:ROWS]).sum(axis=1, dtype=np.uint64) + np.uint64(b + 1) * MULTIPLIERS[6])
                yield pd.DataFrame({"key": part["key"].iloc[some].to_numpy(), "size": part["text"].iloc[some].str.len().to_numpy(), "bands": list(out.view(np.int64))})
        _hashes.clear()
        give_back()

    return small_batches(docs).mapInPandas(keys, "key binary, size long, bands array<long>").select("key", "size", F.explode("bands").alias("band")).dropDuplicates(["band", "key"])


def _blocks(n: str, size: str) -> Column:
    """How many blocks n texts of `size` characters in all are dealt into."""
    return F.greatest(F.lit(1), F.ceil(F.col(n) / BLOCK), F.ceil(F.col(size) / BLOCK_BYTES)).cast("int")


def _by_group(rows: DataFrame, keys: list[str], links: Callable) -> DataFrame:
    """Links (a, b) found in groups of rows with the same keys: links(columns of the group, sets of its texts) for each group.

    Groups are many and mostly small, so Python gets batches of whole groups, and the shingles of a batch's texts are
    made at once; only a group that is larger than a batch is put together from several.
    """

    def found(frame: pd.DataFrame) -> pd.DataFrame:
        code, _ = pd.factorize(frame["key"])
        at = np.unique(code, return_index=True)[1]
        doc, h, n = shingles(frame["text"].iloc[at].tolist())
        edge = np.searchsorted(doc, np.arange(len(at) + 1))
        sets = [(h[lo:hi], n[lo:hi]) for lo, hi in zip(edge, edge[1:])]
        new = np.zeros(len(frame), bool)
        for k in keys:
            v = frame[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        edges = [0, *np.flatnonzero(new).tolist(), len(frame)]
        code, columns, out = code.tolist(), {c: frame[c].tolist() for c in frame.columns if c != "text"}, []
        for lo, hi in zip(edges, edges[1:]):
            if hi - lo > 1:
                out += links({c: v[lo:hi] for c, v in columns.items()}, [sets[c] for c in code[lo:hi]])
        return pd.DataFrame(out, columns=["a", "b"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if len(held):
                last = np.logical_and.reduce([held[k].to_numpy() == held[k].iloc[-1] for k in keys])
                cut = int(np.argmax(last))
                if cut:
                    yield found(held.iloc[:cut])
                    held = held.iloc[cut:].reset_index(drop=True)
        if held is not None and len(held):
            yield found(held)
        _hashes.clear()
        give_back()

    return small_batches(rows).repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, "a binary, b binary")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs: distinct (a, b, size: of b). Those whose texts are similar.

    The texts b of an a are dealt into blocks, and a's text is sent once to each of them, so an `a` may have any number of pairs.
    """
    counts = pairs.groupBy("a").agg(_blocks_of("size").alias("blocks"))
    members = pairs.join(counts, "a").select("a", F.pmod(F.xxhash64("b"), "blocks").cast("int").alias("i"), F.col("b").alias("key"), F.lit(False).alias("first"))
    firsts = counts.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.col("a").alias("key"), F.lit(True).alias("first"))

    def links(group: dict[str, list], sets: list[tuple]) -> list[tuple]:
        own = group["first"].index(True)
        return [(group["key"][own], group["key"][k]) for k in range(len(sets)) if k != own and probability_jaccard(sets[own], sets[k]) >= SIMILARITY]

    return checkpointed(_by_group(members.unionByName(firsts).join(texts, "key"), ["a", "i"], links))


def _blocks_of(size: str) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(size) / BLOCK_BYTES)).cast("int")


def components(links: DataFrame) -> DataFrame:
    """(key, label) of each end of links (a, b): the least key it is connected with. Labels move along links and jump along labels until none changes."""
    both = checkpointed(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("key"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("key", "b"), "b").groupBy("a").agg(F.min("label").alias("m")).withColumnRenamed("a", "key")
        moved = labels.join(near, "key").select("key", F.col("label").alias("old"), F.least("label", "m").alias("at"))
        jumped = moved.join(labels.select(F.col("key").alias("at"), F.col("label").alias("far")), "at", "left")
        after = checkpointed(jumped.select("key", "old", F.least("at", F.coalesce("far", "at")).alias("label")))
        labels = after.select("key", "label")
        if after.where("old <> label").isEmpty():
            return labels


def _open_buckets(shared: DataFrame, labels: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """shared: band, key, size. The rows of buckets that hold several labels, with `label`; and of each bucket band, main (its most frequent label), n, few (texts of other labels), bytes, and the first and last key lo, hi."""
    named = shared.withColumn("label", F.col("key")) if labels is None else shared.join(labels, "key", "left").select("band", "key", "size", F.coalesce("label", "key").alias("label"))
    by_label = named.groupBy("band", "label").agg(F.count(F.lit(1)).alias("k"), F.sum("size").alias("s"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    counts = by_label.groupBy("band").agg(F.max(F.struct("k", "label"))["label"].alias("main"), F.sum("k").alias("n"), (F.sum("k") - F.max("k")).alias("few"), F.sum("s").alias("bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("few > 0")
    counts = checkpointed(counts)
    return checkpointed(named.join(counts.drop("lo", "hi"), "band")), counts


def _centred(open_: DataFrame, turn: int) -> DataFrame:
    """(a, b, size of b): each text with up to CENTRES texts of its buckets, one of each, those that it shares most bands with first.

    In the first turn a bucket offers the text that meets most others in all its buckets, as that one is the likeliest
    to be similar to them; later, to texts outside its main label, one of the main label by hash.
    """
    if turn:
        centre = open_.where("label = main").groupBy("band").agg(F.min(F.struct(F.xxhash64("key", F.lit(turn)).alias("h"), "key"))["key"].alias("a"))
        others = open_.where("label <> main").join(centre, "band")
    else:
        met = open_.groupBy("key").agg(F.sum("n").alias("met"))
        centre = open_.select("band", "key").join(met, "key").groupBy("band").agg(F.max(F.struct("met", "key"))["key"].alias("a"))
        others = open_.join(centre, "band").where("key <> a")
    pairs = others.groupBy("a", F.col("key").alias("b"), "size").agg(F.count(F.lit(1)).alias("bands"))
    best = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("bands"), F.xxhash64("a", F.lit(turn)), "a"))
    return checkpointed(pairs.withColumn("at", best).where(F.col("at") <= CENTRES).select("a", "b", "size"))


def link_texts(distinct: DataFrame) -> DataFrame:
    """distinct: key, text (rows of a key have the same text). Returns (key, label) of the texts that are similar to another one.

    In turns, each text is compared with up to CENTRES others of its buckets, and what is linked gets a label; later
    turns leave out what has the main label of its bucket already. When another turn would not save much, the texts
    outside the main label are compared with all others of their bucket. Pairs within a label need no comparison, so n
    near copies cost a few times n of them, and no link between labels is lost.
    """
    bands = checkpointed(band_keys(distinct))
    shared = checkpointed(bands.join(bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "band").drop("n"))
    texts = checkpointed(distinct.join(shared.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]))
    links = labels = met = None
    (open_, counts), cheap, turn, before = _open_buckets(shared, None), CHEAP * texts.count(), 0, None
    while True:
        pairs = _centred(open_, turn)
        found, own = _verified(pairs, texts), pairs.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
        met = own if met is None else met.unionByName(own)
        links = found if links is None else links.unionByName(found)
        labels = components(links)
        (open_, counts), turn = _open_buckets(shared, labels), turn + 1
        left = counts.agg(F.coalesce(F.sum(F.col("few") * F.col("n")), F.lit(0))).first()[0]
        if left <= cheap or before is not None and left > 0.7 * before:
            break
        before = left
    if not left:
        return labels
    twos = counts.where("n = 2").select("lo", "hi").distinct().join(met, ["lo", "hi"], "left_anti")  # pairs that are a bucket and were not compared yet
    twos = twos.select(F.col("lo").alias("a"), F.col("hi").alias("b")).join(texts.select(F.col("key").alias("b"), F.length("text").cast("long").alias("size")), "b")
    open_ = open_.where("n > 2")
    large = open_.where(F.col("few") * F.col("n") > MANY)
    if not large.isEmpty():
        open_ = open_.where(F.col("few") * F.col("n") <= MANY).unionByName(_by_rare_shingles(large, texts))
    more = checkpointed(_verified(twos, texts).unionByName(_compare_open(open_, texts)))
    return labels if more.isEmpty() else components(links.unionByName(more))


def _by_rare_shingles(large: DataFrame, texts: DataFrame) -> DataFrame:
    """The open texts of large buckets in other buckets, one for each of a text's rarest shingles up to 1 - SIMILARITY of its weight.

    The similarity is at most the weight that either text has on shingles of both. Of a similar pair the rarest common
    shingle therefore has less than 1 - SIMILARITY of each text's weight before it: the pair meets in that bucket.
    """
    texts = large.select("key", "size").distinct().join(texts, "key")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 200):
                part = batch.iloc[lo : lo + 200]
                doc, h, n = shingles(part["text"].tolist())
                share = n / np.bincount(doc, n, minlength=len(part))[doc]
                yield pd.DataFrame({"key": part["key"].to_numpy()[doc], "size": part["size"].to_numpy()[doc], "band": h.view(np.int64), "share": share})

    each = checkpointed(small_batches(texts).select("key", "size", "text").mapInPandas(spread, "key binary, size long, band long, share double"))
    before = F.coalesce(F.sum("share").over(Window.partitionBy("key").orderBy("often", "band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    often = each.groupBy("band").agg(F.count(F.lit(1)).alias("often"))
    rare = checkpointed(each.join(often, "band").withColumn("before", before).where((F.col("before") <= 1 - SIMILARITY + 1e-6) & (F.col("often") > 1)).select("band", "key", "size"))
    return _open_buckets(rare.select("band", "key", "size"), large.select("key", "label").distinct())[0]


def _shared_mass(da, ha, na, a: int, db, hb, nb, b: int, slab: int = 4_000) -> tuple[np.ndarray, np.ndarray]:
    """For texts of two lists the share of each one's shingle weight that lies on shingles of the other, by products over slabs of shared shingles."""
    shared = np.intersect1d(ha, hb)
    total_a, total_b = np.maximum(np.bincount(da, na, minlength=a), 1), np.maximum(np.bincount(db, nb, minlength=b), 1)
    of_a, of_b = np.zeros((a, b), np.float32), np.zeros((a, b), np.float32)
    for lo in range(0, len(shared), slab):
        some = shared[lo : lo + slab]

        def spread(d, h, n, total, rows):
            at = np.minimum(np.searchsorted(some, h), len(some) - 1)
            own = some[at] == h
            weight, there = np.zeros((rows, len(some)), np.float32), np.zeros((rows, len(some)), np.float32)
            weight[d[own], at[own]], there[d[own], at[own]] = n[own] / total[d[own]], 1
            return weight, there

        (wa, ia), (wb, ib) = spread(da, ha, na, total_a, a), spread(db, hb, nb, total_b, b)
        of_a += wa @ ib.T
        of_b += ia @ wb.T
    return of_a + 1e-4, of_b + 1e-4


def _compare_open(open_: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between texts of a bucket that have different labels: those outside the bucket's main label against all, in blocks of about BLOCK by BLOCK texts."""
    size = lambda c: _blocks(c, "bytes")
    part = lambda c: F.pmod(F.xxhash64("key"), size(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), size(c) - 1))
    few = open_.where("label <> main").select("band", part("few").alias("i"), every("n").alias("j"), "key", "label", F.lit(True).alias("few"))
    all_ = open_.select("band", every("few").alias("i"), part("n").alias("j"), "key", "label", F.lit(False).alias("few"))

    def links(group: dict[str, list], sets: list[tuple]) -> list[tuple]:
        left, right = ([k for k, few in enumerate(group["few"]) if few is own] for own in (True, False))
        keys, labels, met, out = group["key"], group["label"], set(), []
        maybe = ((r, c) for r in left for c in right if labels[r] != labels[c]) if len(left) * len(right) < 64 else _candidates(left, right, labels, sets)
        for r, c in maybe:
            if (r, labels[c]) not in met and probability_jaccard(sets[r], sets[c]) >= SIMILARITY:
                met.add((r, labels[c]))
                out.append((min(keys[r], keys[c]), max(keys[r], keys[c])))
        return out

    return _by_group(few.unionByName(all_).join(texts, "key"), ["band", "i", "j"], links).distinct()


def _candidates(left: list[int], right: list[int], labels: list, sets: list[tuple]) -> Iterator[tuple[int, int]]:
    """Pairs of texts of different labels that can be similar by the weight that they have on shared shingles."""

    def flat(some: list[int]) -> tuple:
        sizes = [len(sets[k][0]) for k in some]
        return np.repeat(np.arange(len(some)), sizes), np.concatenate([sets[k][0] for k in some]), np.concatenate([sets[k][1] for k in some])

    (da, ha, na), (db, hb, nb) = flat(left), flat(right)
    share_a, share_b = _shared_mass(da, ha, na, len(left), db, hb, nb, len(right))
    names = {x: k for k, x in enumerate(dict.fromkeys(labels))}
    number = np.array([names[x] for x in labels])
    # the probability Jaccard is at most the mass that either text has on shared shingles
    maybe = (np.minimum(share_a, share_b) >= SIMILARITY) & (number[left][:, None] != number[right][None, :])
    plain = (np.bincount(da, na > 1, minlength=len(left)) == 0)[:, None] & (np.bincount(db, nb > 1, minlength=len(right)) == 0)[None, :]
    maybe &= ~plain | (1 / (1 / share_a + 1 / share_b - 1) >= SIMILARITY - 1e-3)  # without repeats it is the plain Jaccard
    return ((left[r], right[c]) for r, c in zip(*(x.tolist() for x in np.nonzero(maybe))))


def _classed(rows: DataFrame) -> DataFrame:
    """rows: doc_id, text, key and others. The same rows with class_id and `first`: whether the row has the doc_id and the text that its class is named by."""
    labels = link_texts(rows.where("text is not null").select("key", "text"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("least")
    by_text = rows.where("key is not null").groupBy("key").agg(least, F.count(F.lit(1)).alias("rows")).join(labels, "key", "left").where("rows > 1 or label is not null")
    by_text = checkpointed(by_text.select("key", F.coalesce("label", "key").alias("label"), "least"))
    classes = by_text.groupBy("label").agg(F.min(F.struct("least", "key")).alias("name"))
    named = by_text.join(classes, "label").select("key", F.col("name.least.doc_id").alias("class_id"), F.col("name.key").alias("first_key"))
    found = rows.drop("text").join(named, "key", "left")
    single = F.col("first_key").isNull()
    return found.withColumn("first", single | ((F.col("key") == F.col("first_key")) & F.col("doc_id").eqNullSafe(F.col("class_id")))).withColumn("class_id", F.when(single, F.col("doc_id")).otherwise(F.col("class_id"))).withColumn("single", single)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, class_id (the least doc_id of its class).

    Words are runs of letters and digits, lower-cased; shingles have 5 words and their counts as weights; texts are
    linked at a probability Jaccard of 0.8 or more, and classes are what links connect. Equal texts are one class, also
    texts without words. A null text is a class of its own row (class_id = doc_id). Nulls in doc_id are kept and never
    are a class_id unless all ids of the class are null. Repeated rows are exact copies. An empty table gives an empty
    result; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("key", text_key(F.col("text")))
    return _classed(rows).select("doc_id", "class_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each class: one that has the least doc_id of the class and, if that has several texts, the first of them by key.

    Of rows that repeat this doc_id and text any one stays. A row with a null text stays. Columns of any name stay as they are.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kept = _classed(rows.withColumn("key", text_key(F.col("text")))).where("first").select("row", "doc_id", "key", "single")
    return kept.where("single").select("row.*").unionByName(kept.where("not single").dropDuplicates(["doc_id", "key"]).select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")
