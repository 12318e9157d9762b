"""Quality rules as a short-circuit cascade: a sample gives each rule's cost and rejection rate, and the rule with most rejection per cost runs first."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, give_back, small_batches, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS, DIGITS = "#*$%&|<>", "0123456789"
WINDOW = 8
#: Rows of the sample that the order of the rules is estimated on.
SAMPLE_ROWS = 400


class Facts:
    """Facts of one text, each worked out when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    def __getattr__(self, name: str):
        value = getattr(self, f"_{name}")()
        setattr(self, name, value)
        return value

    def _words(self):
        return WORD.findall(self.text)

    def _n_words(self):
        return len(self.words)

    def _word_chars(self):
        return sum(map(len, self.words))

    def _n_symbols(self):
        return sum(map(self.text.count, SYMBOLS))

    def _n_digits(self):
        return sum(map(self.text.count, DIGITS))

    def _n_shouts(self):
        return self.text.count("!")

    def _lines(self):
        return [x for x in self.text.split("\n") if WORD.search(x)]

    def _n_dup_lines(self):
        return len(self.lines) - len(set(self.lines))

    def _n_repeat_words(self):
        n = self.n_words - WINDOW + 1
        if n < 2:
            return 0
        first: dict[str, int] = {}
        at = np.fromiter((first.setdefault(w, len(first)) for w in self.words), dtype=np.int64, count=self.n_words)
        step = 1
        while step < WINDOW:  # names of windows of 2, 4 and 8 words
            pairs = at[:-step] * (self.n_words + 1) + at[step:]
            at = np.unique(pairs, return_inverse=True)[1]
            step *= 2
        again = (np.bincount(at) > 1)[at]
        if not again.any():
            return 0
        edge = np.zeros(self.n_words + 1, dtype=np.int64)
        starts = np.flatnonzero(again)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + WINDOW, -1)
        return int((np.cumsum(edge)[:-1] > 0).sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Facts], bool]


RULES = (
    Rule("few_words", lambda f: f.n_words < 20),
    Rule("repeated_windows", lambda f: 100 * f.n_repeat_words > 30 * f.n_words),
    Rule("many_symbols", lambda f: 10 * f.n_symbols > f.n_words),
    Rule("many_digits", lambda f: 10 * f.n_digits > 3 * f.word_chars),
    Rule("shouting", lambda f: 2 * f.n_shouts > f.n_words),
    Rule("repeated_lines", lambda f: 10 * f.n_dup_lines > 5 * len(f.lines)),
    Rule("word_length", lambda f: f.word_chars < 2 * f.n_words or f.word_chars > 25 * f.n_words),
)
BASE = ("few_words", "repeated_windows")


def estimate_order(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of the rules by rejection per second on a bounded sample, most first. Only the order of work depends on it, never a verdict."""
    names = [r.name for r in rules]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_name = {r.name: r for r in rules}
        for batch in batches:
            out = []
            for name in names:
                began, rejected = time.perf_counter(), sum(by_name[name].rejects(Facts(t)) for t in batch["text"])
                out.append((name, time.perf_counter() - began, rejected))
            yield pd.DataFrame(out, columns=["name", "seconds", "rejected"])

    sample = bounded_sample(docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, (c, kind) in enumerate(docs.dtypes) if c != text and "map<" not in kind], F.col(text).cast("string").alias("text")).where("text is not null"), sample_rows).select("text")
    found = sample.mapInPandas(measure, "name string, seconds double, rejected long").groupBy("name").agg(F.sum("seconds").alias("s"), F.sum("rejected").alias("r")).collect()
    worth = {x.name: x.r / max(x.s, 1e-9) for x in found}
    return sorted(names, key=lambda n: (-worth.get(n, 0.0), n))


def quality_cascade(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, order: list[str] | None = None, with_facts: bool = False) -> DataFrame:
    """docs with n_rules_run int, rejected_by string (null: kept) and, if asked for, facts of the text.

    Rules run in the estimated order until one rejects. A null text counts as an empty one, which few_words rejects.
    Repeated rows get the same verdict; an empty table gives an empty result. Added columns are named rule_*; an input
    column of such a name is dropped.
    """
    order = order or estimate_order(docs, text, rules)
    ranked = [r for n in order for r in rules if r.name == n]
    kind = "rejected_by string, n_rules_run int, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
    base = [r for r in rules if r.name in BASE]

    @F.pandas_udf(kind)
    def judge(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            f, why, ran = Facts(t), None, 0
            for r in ranked:
                ran += 1
                if r.rejects(f):
                    why = r.name
                    break
            facts = (f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, any(r.rejects(f) for r in base)) if with_facts else (None,) * 6
            out.append((why, ran, *facts))
        give_back()
        return pd.DataFrame(out, columns=["rejected_by", "n_rules_run", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"])

    return small_batches(docs).withColumn("rule_facts", judge(F.col(text).cast("string")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    f = F.col("rule_facts")
    return quality_cascade(docs, with_facts=True).select("doc_id", *[f[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")], f["rejected_by"].isNull().alias("kept"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
w AS (SELECT rid, unnest(range(1, len(ws) - 6)) AS p, ws FROM f WHERE len(ws) >= 8),
g AS (SELECT rid, p, list_slice(ws, p, p + 7) AS win FROM w),
m AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, win) AS n FROM g),
r AS (SELECT rid, count(DISTINCT p + k) AS n FROM m, range(0, 8) AS o(k) WHERE n > 1 GROUP BY rid),
s AS (SELECT f.rid, doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(r.n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(t, '[^0-9]', '', 'g')) AS n_digits,
  length(regexp_replace(t, '[^!]', '', 'g')) AS n_shouts, len(ls) AS n_lines FROM f LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_digits > 3 * word_chars OR 2 * n_shouts > n_words OR 10 * n_dup_lines > 5 * n_lines
    OR word_chars < 2 * n_words OR word_chars > 25 * n_words) AS kept
FROM b
"""
