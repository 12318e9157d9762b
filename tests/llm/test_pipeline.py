import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from facetframe.llm import decontaminate, near_dedup, packing, pii
from facetframe.llm.quality_rules import RULES, Facts

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(20_000))
SEVEN = " ".join(f"several{i} words" for i in range(15))
STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and columns named like internal ones."""
    rows = [(1, None, "en", "s", None), (2, "", None, "s", 0), (3, LONG, "en", None, len(LONG)), (3, LONG, "en", None, len(LONG)), (None, SEVEN, "en", "s", len(SEVEN)), (5, SEVEN, None, None, None), (5, SEVEN + " and more of it at the end", "fr", "s", 1), (6, "a.b@c.example.com " * 30, "fr", "s", 1), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("row", "key", "found", "new", "n", "class_id", "first", "single", "rule_facts", "whole", "clean", "n_words", "n_entities", "label", "_rank", "_block"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_quality_stage(spark, docs):
    assert rows_of(STAGE["quality_rules"](spark, docs, SF)) == sorted((tuple(r) for r in docs.select(*COLUMNS).collect() if not any(x.rejects(Facts(r.text)) for x in RULES)), key=str)


def test_dedup_stage(spark, docs):
    some = sorted((tuple(r) for r in docs.select(*COLUMNS).collect()), key=lambda r: r[0])
    sets = [near_dedup.shingles([r[1] or ""])[1:] for r in some]
    top = list(range(len(some)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(some)):
        for j in range(i):
            if some[i][1] is not None and (some[i][1] == some[j][1] or near_dedup.probability_jaccard(sets[i], sets[j]) >= 0.8):
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
    assert rows_of(STAGE["near_dedup"](spark, docs, SF)) == sorted((r for i, r in enumerate(some) if root(i) == i), key=str)


def test_decontaminate_stage(spark, docs):
    items = [decontaminate.words_of(r.text or "") for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + 10]) for w in items if w for k in range(max(1, len(w) - 9))}
    want = []
    for r in docs.select(*COLUMNS).collect():
        text, places, words = r.text or "", [m.span() for m in decontaminate.WORD.finditer(r.text or "")], decontaminate.words_of(r.text or "")
        hit = {k + i for n in {len(w) for w in windows} for k in range(len(words) - n + 1) if tuple(words[k : k + n]) in windows for i in range(n)}
        if not hit:
            want.append(tuple(r))
            continue
        gone = np.zeros(len(text), bool)
        for k in hit:
            gone[slice(*places[k])] = True
            if k + 1 in hit:
                gone[places[k][1] : places[k + 1][0]] = True
        left = "".join(c for c, g in zip(text, gone) if not g)
        want.append((r.doc_id, left, r.lang, r.source, len(left)))
    assert rows_of(STAGE["decontaminate"](spark, docs, SF)) == sorted(want, key=str)


def test_pii_stage_is_distinct_and_consistent(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names = [(100_000 + i, f"{title} {name} met Mr Abel Smith and Mrs Abel Smith. " + "x" * i, "en", "s", 1) for i, (title, name) in enumerate((t, n) for t in ("Mr", "Frau") for n in ("John Smith", "Smith", "Anna Brown", "Brown", "John Brown"))]
    docs = docs.select(*COLUMNS).unionByName(spark.createDataFrame(names, docs.select(*COLUMNS).schema))
    old, new = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in STAGE["pii"](spark, docs, SF).collect()}
    kinds = {k: re.compile(p) for k, p in pii.PATTERNS.items() if k not in ("person",) and "\\p{" not in p}
    assert old.keys() == new.keys()
    there, back = {}, {}
    for i, r in old.items():
        a, b = r.text, new[i].text
        if a is None:
            assert b is None
            continue
        if a != b:
            assert new[i].n_chars == len(b)
        for k in ("email", "ip", "secret"):
            one, two = kinds[k].findall(a), kinds[k].findall(b)
            assert len(one) == len(two)
            for x, y in zip(one, two):
                x, y = x.lower(), y.lower()
                assert x != y and there.setdefault((k, x), y) == y and back.setdefault((k, y), x) == x
    surname = {}
    for i, text, *_ in names:
        words = dict(zip(re.findall(r"\w+", text), re.findall(r"\w+", new[i].text)))
        for w in ("Smith", "Brown"):
            if w in words:
                assert words[w] != w and surname.setdefault(w, words[w]) == words[w]
    assert len(set(surname.values())) == 2
    assert any(a.text != new[i].text for i, a in old.items() if i < 100_000)


def test_clean_numbers_stay(spark):
    text = "order 1234567890123456 and version 1.2.3 of 2024-01-02"
    got = pii.replace_entities(spark.createDataFrame([(1, text), (2, "card 4111111111111111")], "doc_id long, text string"), "k").orderBy("doc_id").collect()
    assert got[0].text == text and got[0].n_entities == 0 and got[1].n_entities == 1 and "4111111111111111" not in got[1].text
    other = pii.replace_entities(spark.createDataFrame([(2, "card 4111111111111111")], "doc_id long, text string"), "another").collect()
    assert other[0].text != got[1].text


def test_packing_stage(spark, docs):
    rows = STAGE["packing"](spark, docs, SF).collect()
    histogram = defaultdict(int)
    for r in rows:
        histogram[r.length] += 1
    by_seq = defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append(r)
    plan = packing.plan(dict(histogram))
    want = sorted(p for p, n in plan for _ in range(n))
    assert sorted(tuple(r.length for r in sorted(x, key=lambda r: r.offset)) for x in by_seq.values()) == want
    assert all(sum(r.length for r in x) <= 2048 for x in by_seq.values())
    assert zlib.crc32(np.array([1], "<u4").tobytes()) in {r.ids_crc32 for r in rows} or all(d.text for d in docs.collect())


def test_repeated_lengths_share_a_slot(spark):
    cut = spark.createDataFrame([(i, 0, n, i, n) for i, n in enumerate([3] * 50 + [5] * 11 + [7] * 3)], "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    by = defaultdict(list)
    for r in packing.pack(cut, 16).collect():
        by[r.sequence_id].append((r.offset, r.length))
    assert sum(map(len, by.values())) == 64 and sorted(by) == list(range(len(by)))
    for x in by.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 16


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows_in_every_stage(spark, odd, name):
    got = STAGE[name](spark, odd, SF)
    if name != "packing":
        assert got.columns == COLUMNS
    n = {"quality_rules": 3, "near_dedup": 7, "decontaminate": 9, "pii": 9}.get(name)
    if n:
        assert got.count() == n
    else:
        assert got.where("start = 0").count() == 9
    assert STAGE[name](spark, odd.limit(0), SF).count() == 0


def test_keep_one_goes_by_row(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text), (5, text + " x"), (5, "quite another text of a few words"), (3, text)]
    kept = near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string").withColumn("_rows", F.lit(1)))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(3, text), (5, "quite another text of a few words")]


def test_large_buckets_are_dealt_by_rare_shingles(spark, monkeypatch):
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(f"n{k}x{i}" if (i * 7 + k) % 120 < 3 * (k % 9) else w for i, w in enumerate(base)) for k in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(map(tuple, near_dedup.near_duplicates(df).collect()))
    monkeypatch.setattr(near_dedup, "MANY", 1)
    monkeypatch.setattr(near_dedup, "CHEAP", 0)
    assert sorted(map(tuple, near_dedup.near_duplicates(df).collect())) == want


def test_null_item_ids(spark):
    words = " ".join(f"w{i}" for i in range(12))
    bench = spark.createDataFrame([(None, words), (7, words), (8, "w0 w1")], "item_id long, text string")
    docs = spark.createDataFrame([(None, words), (2**60 + 1, "W0 w1 other"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench).collect()}
    assert got[None].item_ids == ["7", "8"] and got[None].n_hit == 12 and got[2**60 + 1].n_hit == 2 and got[3].n_words == 0


def test_run_goes_through_all_stages(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for stage in list(STAGE.values())[:-1]:
        docs = stage(spark, docs, SF)
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()}
