import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetframe.llm import langid, quality_crf, toxicity, url_filter
from facetframe.llm.quality_rules import Facts

SF = "/root/testdata/sf0.001"


def mined_by_hand(rows, support, confidence, most):
    n, where = len(rows), defaultdict(set)
    for i, (tokens, _) in enumerate(rows):
        for t in tokens:
            where[t].add(i)
    item = {}
    for t in sorted(where):
        if len(where[t]) >= support * n:
            item.setdefault(frozenset(where[t]), t)
    names = sorted(item.values())
    rules = {}
    for k in range(1, most + 1):
        for some in itertools.combinations(names, k):
            at = set.intersection(*(where[t] for t in some))
            for label in {y for _, y in rows}:
                hit = sum(rows[i][1] == label for i in at)
                if hit >= support * n and hit >= confidence * len(at):
                    rules[some, label] = hit / len(at)
    return {(s, y): c for (s, y), c in rules.items() if not any(rules.get((p, y), 0) >= c for k in range(1, len(s)) for p in itertools.combinations(s, k)) and not (len(s) > 1 and any(len(where[t]) == n for t in s))}


def test_mined_rules_equal_brute_force(spark):
    r = random.Random(5)
    rows = []
    for i in range(120):
        tokens = {f"t{r.randrange(9)}" for _ in range(4)} | ({"long1", "long2", "long3"} if i % 3 == 0 else set()) | {"all"}
        rows.append((sorted(tokens), "block" if ("t1" in tokens and "t2" in tokens) or "t7" in tokens or ("t3" in tokens and r.random() < 0.95) else "allow"))
    got = url_filter.mine_rules(spark.createDataFrame(rows, "tokens array<string>, label string"), url_filter.Mining(0.05, 0.8, 3)).collect()
    want = mined_by_hand(rows, 0.05, 0.8, 3)
    assert {(tuple(x.tokens), x.label) for x in got} == set(want) and any(len(s) > 1 for s, _ in want)
    assert all(abs(x.confidence - want[tuple(x.tokens), x.label]) < 1e-9 and x.anchor in x.tokens for x in got)


def test_long_shared_paths_do_not_multiply(spark):
    path = [f"p:{k}" for k in range(25)]
    rows = [([*path, f"h:{i % 7}"] if i % 2 else [f"h:{i % 7}"], "block" if i % 4 else "allow") for i in range(200)]
    assert url_filter.mine_rules(spark.createDataFrame(rows, "tokens array<string>, label string")).count() < 50


def test_mined_rules_of_nothing(spark):
    empty = spark.createDataFrame([], "tokens array<string>, label string")
    assert url_filter.mine_rules(empty).count() == 0
    assert url_filter.mine_rules(spark.createDataFrame([(["a"], None), (None, "block"), ([], "block")], "tokens array<string>, label string")).count() == 0


def test_odd_urls(spark):
    rows = [(1, None), (2, ""), (3, "http://x.com/de/" + "a/" * 5000), (3, "http://x.com/de/" + "a/" * 5000), (None, "http://y.net/q?a=1")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("tokens", F.lit(1)).withColumn("rule", F.lit("x"))
    got = url_filter.judge_urls(df).collect()
    assert sorted((r.page_id or 0, r.verdict) for r in got) == [(0, "allow"), (1, "allow"), (2, "allow"), (3, "block"), (3, "block")]
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_language_filters_against_exact_dictionary(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null and lang is not null")
    filters = langid.fit(docs)
    texts = docs.select("text", "lang").collect()
    counts = defaultdict(Counter)
    for r in texts:
        counts[r.lang].update(langid.grams(r.text).tolist())
    total = {x: sum(c.values()) for x, c in counts.items()}
    top = Counter()
    for x, c in counts.items():
        for h, n in c.items():
            if n >= langid.MIN_COUNT:
                top[h] = max(top[h], n / total[x])
    own = {x: {h for h, n in c.items() if n >= langid.MIN_COUNT and n / total[x] >= langid.MIN_SHARE * top[h]} for x, c in counts.items()}
    for r in texts[:60]:
        h = langid.grams(r.text)
        exact = np.array([sum(g in own[x] for g in h.tolist()) for x in filters.languages])
        assert np.all(np.abs(filters.counts(h) - exact) <= 0.02 * len(h) + 2)
    assert langid.grams("\U0002ceb0\U00030000\U00030001").size and filters.judge("\U00030000\U00030001\U00030002")[0] != "und"
    assert filters.judge(None) == filters.judge("12 !!") == ("und", 0.0)


def test_rare_language_keeps_its_grams(spark):
    rows = [(i, "the cat and the dog ran over there", "en") for i in range(3000)] + [(9000 + i, f"кот и пёс {i} пошли домой", "ru") for i in range(5)]
    filters = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=100)
    assert filters.judge("кот пошёл домой")[0] == "ru" and filters.judge("the dog")[0] == "en"


def test_lexicon_hits_equal_plain_search():
    r = random.Random(2)
    entries = {"".join(r.choice("abc") for _ in range(r.randint(2, 4))): 1.0 for _ in range(12)}
    lexicon = toxicity.Lexicon(entries)
    for _ in range(300):
        text = "".join(r.choice("abc ,-") for _ in range(30))
        want = []
        for i in range(len(text)):
            if i == 0 or not text[i - 1].isalnum():
                best = max((e for e in entries if text.startswith(e, i)), key=len, default=None)
                if best:
                    want.append((i, best, 1.0))
        assert lexicon.hits(text) == want


def test_neighbour_words_at_any_distance():
    gap = " ." * 500
    assert toxicity.phrases_at(f"village{gap}idiotically{gap}speaking", 7 + len(gap), "idiot") == [("village", "idiot"), ("idiot", "speaking")]
    lexicon = toxicity.Lexicon({"idiot": 5.0}, {("village", "idiot")}, (-3.0, 4.0, 0.0))
    assert lexicon.score("village" + gap + "idiot") < 0.5 < lexicon.score("city" + gap + "idiot")


def test_marginals_equal_enumeration():
    r = np.random.default_rng(1)
    for n in (1, 2, 5):
        unary, pair = np.zeros((1, n, 2)), r.normal(size=(2, 2))
        unary[0] = r.normal(size=(n, 2))
        weight = {}
        for labels in itertools.product((0, 1), repeat=n):
            weight[labels] = math.exp(sum(unary[0, i, y] for i, y in enumerate(labels)) + sum(pair[a, b] for a, b in zip(labels, labels[1:])))
        z = sum(weight.values())
        marginal, moves, log_z = quality_crf._chain(unary, pair, np.array([n]))
        assert abs(log_z - math.log(z)) < 1e-9
        for i in range(n):
            assert abs(marginal[0, i, 1] - sum(w for y, w in weight.items() if y[i]) / z) < 1e-9
        for a, b in itertools.product((0, 1), repeat=2):
            assert abs(moves[a, b] - sum(w * sum((x, y) == (a, b) for x, y in zip(k, k[1:])) for k, w in weight.items()) / z) < 1e-9


def test_quality_is_weighted_by_length():
    field = quality_crf.Field()
    field.weights[3 * quality_crf.OWN + 1] = 40.0  # every line is good
    assert field.quality("one line\nanother line") > 0.999 and field.quality(None) == field.quality(" \n ") == 0.0
    field.weights[:] = 0
    field.weights[0] = -40.0  # lines with symbols are bad, others undecided
    assert abs(field.quality("#" * 30 + "\n" + "a" * 10) - 0.5 * 10 / 41) < 0.02 or field.quality("#" * 30 + "\n" + "a" * 10) < 0.2


def test_long_texts_are_learned_whole(spark):
    good, bad = "\n".join(["all is well here today."] * 300), "\n".join(["all is well here today."] * 300 + ["### $$$ %%%"] * 600)
    rows = [(f"{good}\n{i}", 1) for i in range(6)] + [(f"{bad}\n{i}", 0) for i in range(6)]
    field = quality_crf.fit(spark.createDataFrame(rows, "text string, quality int"))
    assert field.quality(good) > field.quality(bad) + 0.1


def test_repeated_words_by_hand():
    r = random.Random(3)
    for _ in range(50):
        words = [r.choice("abc") for _ in range(r.randint(0, 60))]
        windows = defaultdict(list)
        for i in range(len(words) - 7):
            windows[tuple(words[i : i + 8])].append(i)
        want = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
        assert Facts(" ".join(words)).n_repeat_words == len(want)


@pytest.mark.parametrize("text", ["", "x", "1d10t", "ＩＤＩＯＴ"])
def test_folding_is_stable(text):
    assert toxicity.fold(toxicity.fold(text)) == toxicity.fold(text) and not re.search("[A-Z]", toxicity.fold(text))
