import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from facetframe.llm import decontaminate, langid, near_dedup, packing, pii, quality_crf, quality_rules, sharding, toxicity, url_filter

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(20_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, a clashing column."""
    rows = [(1, None, "en"), (2, "", None), (3, LONG, "en"), (3, LONG, "en"), (None, "one two three four five six seven", "en"), (5, "one two three four five six seven", None), (6, "mail a.b@c.example.com or A.B@c.example.com, call +1 (743) 555-3824", "fr"), (7, "\n\n!!", "de")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("key", F.lit("clash")).withColumn("label", F.lit(1)).withColumn("_h", F.lit(0))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def sql_rows(sql):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    r = c.sql(sql)
    return sorted(r.columns), sorted(map(str, r.select(*[duckdb.ColumnExpression(x) for x in sorted(r.columns)]).fetchall()))


@pytest.mark.parametrize("module", [quality_rules, decontaminate])
def test_equals_sql(spark, module):
    columns, want = sql_rows(module.SQL)
    assert sorted(map(str, map(tuple, module.query(spark, SF).select(*columns).collect()))) == want


def test_near_duplicates_brute_force(spark, docs):
    some = [(r.doc_id, r.text) for r in docs.collect()]
    sets = {i: near_dedup.shingles([t or ""])[1:] for i, t in some}
    texts, top = dict(some), {i: i for i, _ in some}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and (texts[i] == texts[j] is not None or near_dedup.probability_jaccard(sets[i], sets[j]) >= 0.8):
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
    assert {r.doc_id: r.class_id for r in near_dedup.query(spark, SF).collect()} == {i: root(i) for i in sets}


def test_chain_of_near_copies_is_one_class(spark):
    base = [f"w{i}" for i in range(100)]
    chain = [(k, " ".join(["new%d" % i if i < 2 * k else w for i, w in enumerate(base)])) for k in range(20)]
    got = near_dedup.near_duplicates(spark.createDataFrame(chain, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0}


def test_signature_estimates_probability_jaccard():
    a, b = " ".join(f"a{i}" for i in range(300)), " ".join(f"a{i}" for i in range(40, 300))
    d, h, n = near_dedup.shingles([a, b])
    s = near_dedup.signatures(d, h, n, 2, 2000)
    true = near_dedup.probability_jaccard((h[d == 0], n[d == 0]), (h[d == 1], n[d == 1]))
    assert abs((s[0] == s[1]).mean() - true) < 0.05


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.query(spark, SF).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for d in docs.collect():
        ids, at = np.array([*t.encode(d.text or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(by_doc[d.doc_id], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes()) and r.doc_tokens == len(ids)
            at += r.length
        assert at == len(ids)
    for some in by_seq.values():
        at = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert sorted(by_seq) == list(range(len(by_seq)))
    assert len(by_seq) <= 1.05 * sum(r.length for r in rows) / 2048 + 1


def test_chunks_equal_whole_texts():
    t = packing.ChunkTokenizer(packing.default_tokenizer())
    texts = ["Hello  world\n\tit's 12 o'clock...!!", "", " ", "naïve ÉCOLE <|endoftext|>x", "á b c", "hello world"]
    ids, counts = t.encode(texts)
    at = 0
    for x, n in zip(texts, counts):
        assert ids[at : at + n].tolist() == t.inner.encode(x, add_special_tokens=False).ids
        at += n


def test_shards(spark, docs):
    rows = sharding.shard_documents(docs, per_bucket=40).collect()
    by_shard, of_text = defaultdict(list), {}
    for r in rows:
        by_shard[r.shard].append(r)
        assert of_text.setdefault((r.text_crc32, r.size), r.shard) == r.shard
    sizes = [sum(r.size for r in by_shard[k]) for k in range(8)]
    assert len(rows) == docs.count() and max(sizes) - min(sizes) <= 0.02 * sum(sizes) / 8
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by_shard.values())


def test_differencing_beats_none():
    sizes = np.array([8, 7, 6, 5, 4])
    parts = sharding.difference(sizes, 2)
    assert abs(sizes[parts == 0].sum() - sizes[parts == 1].sum()) == 2


def test_surrogates(spark, odd):
    rows = [(1, "Mr John Smith and Mrs Anna Smith met Mr Smith; Господин Иванов wrote to a.b@x.example.com"), (2, "card 4111111111111111, ip 10.0.200.7, a.b@x.example.com, +1 (743) 555-3824."), (3, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" nothing')]
    got = {r.doc_id: r for r in pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    for i, old in rows:
        for m in re.findall(r"John|Smith|Иванов|a\.b@x|4111111111111111|10\.0\.200\.7|743|24be6443\w+", old):
            assert m not in got[i].text
    names = re.match(r"Mr (\w+) (\w+) and Mrs (\w+) (\w+) met Mr (\w+); Господин (\w+) wrote to (\S+)$", got[1].text)
    assert names[2] == names[4] == names[5] and names[1] != names[3] and re.fullmatch("[А-Яа-я]+", names[6]) and names[3].endswith(("ra", "lia", "nne", "lla"))
    second = re.match(r"card (\d{16}), ip (\d\d)\.(\d)\.(\d{3})\.(\d), (\S+), \+1 \(\d{3}\) \d{3}-\d{4}\.$", got[2].text)
    assert second and second[6] == names[7]
    digits = [int(c) for c in second[1]][::-1]
    assert sum(sum(divmod(d * 2, 10)) if i % 2 else d for i, d in enumerate(digits)) % 10 == 0
    assert re.search(r'token = "[0-9a-f]{40}" nothing', got[3].text)


def test_surrogates_of_more_entities_than_short_ones_exist(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [("surname", "Q" + "".join(letters[i // 26**k % 26] for k in range(4))) for i in range(17_000)] + [("ip", ".".join(f"{i:04}")) for i in range(10_000)]
    rows += [("email", f"{a}@{b}.com") for a in letters for b in letters] + [("email", "-@-.-")]
    entities = spark.createDataFrame(rows, "kind string, norm string").withColumn("mention", F.col("norm")).repartition(8).cache()
    kind, attempt = F.col("kind"), F.coalesce("attempt", F.lit(0))
    made = entities.join(pii.settle(entities, "k"), ["kind", "norm"], "left").select("kind", "mention", pii.surrogate("k", kind, F.col("mention"), pii._stream("k", kind, F.col("norm"), attempt), attempt).alias("new"))
    got = made.collect()
    assert len({(r.kind, r.new) for r in got}) == len(got) == len(rows) and not {r.new for r in got} & {r.mention for r in got}


def test_secrets_without_digits(spark):
    keys = ["AKIA" + "QWERTYUIOPASDFGH", "ghp_" + "abcdefghijklmnopqrstuvwxyzABCDEFGHIJ", "abcdef" * 6, "FEDCBA" * 6]
    rows = [(i, f"the key {k} stands alone") for i, k in enumerate(keys)]
    got = [r for r in sorted(pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect())]
    assert [r.n_entities for r in got] == [1] * 4 and not any(k in r.text for k, r in zip(keys, got))
    assert all(re.fullmatch(p, r.text.split()[2]) for p, r in zip(("AKIA[A-Z]{16}", "ghp_[A-Za-z]{36}", "[a-f]{36}", "[A-F]{36}"), got))


def test_url_rules(spark):
    urls = ["https://A.example.ORG/es/1?x", "http://example.org/en/12", "http://b.org/", "http://b.org", "x.com/de/", None, "https://m.q.com/de/1#t", "https://q.com/fr/2"]
    got = [tuple(r)[1:5] for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()]
    assert got == [("a.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("b.org", "/", "org/", "allow"), ("b.org", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("m.q.com", "/de/1", "com/de/", "block"), ("q.com", "/fr/2", "com/fr/", "allow")]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    r = langid.query(spark, sf).join(lang, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert r > 0.97
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for module, name in ((toxicity, "toxic"), (quality_crf, "quality")):
        r = module.query(spark, sf).join(labels, "doc_id").where("held_out").agg(F.avg((F.col(name) == F.col("predicted")).cast("int"))).first()[0]
        assert r > 0.94, name


def test_folding_finds_disguised_words():
    lexicon = toxicity.Lexicon({"idiot": 5.0}, {("village", "idiot")}, (-3.0, 4.0, 0.0))
    assert all(lexicon.score(f"you {w} there") > 0.5 for w in ("idiot", "IDIOT", "1d10t", "іdіоt"))
    assert lexicon.score("the village idiot there") < 0.5 and lexicon.score(None) < 0.5


def test_odd_rows(spark, odd):
    for df in (odd, odd.limit(0)):
        n = df.count()
        assert near_dedup.near_duplicates(df).count() == n
        assert sharding.shard_documents(df).count() == n
        assert quality_rules.quality_cascade(df, with_facts=True).count() == n
        assert pii.replace_entities(df, "k").count() == n
        assert packing.pack_documents(df, packing.default_tokenizer()).select("doc_id").distinct().count() == (7 if n else 0)
        bench = spark.createDataFrame([("i", "one two three"), ("j", None), ("k", "")], "item_id string, text string")
        hits = decontaminate.decontaminate(df, bench).where("n_hit > 0").collect()
        assert [r.n_hit for r in hits] == ([3, 3] if n else [])
        filters = langid.fit(df)
        assert langid.identify(df, filters).count() == n
        assert toxicity.score_toxicity(df, toxicity.fit(df.withColumn("toxic", F.lit(1)))).count() == n
        assert quality_crf.score_quality(df, quality_crf.fit(df.withColumn("quality", F.lit(1)))).count() == n
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(odd).where("doc_id in (1, 3, 5)").collect()} == {1: 1, 3: 3, 5: 5}
    assert near_dedup.keep_one(odd).count() == 6


def test_blocks_of_a_large_benchmark(spark, docs, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    one = {r.doc_id: (r.n_words, r.n_hit, sorted(r.item_ids)) for r in decontaminate.decontaminate(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2000)
    assert {r.doc_id: (r.n_words, r.n_hit, sorted(r.item_ids)) for r in decontaminate.decontaminate(docs, bench).collect()} == one
