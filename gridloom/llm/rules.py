"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule is a predicate on a text that is true for texts to reject. ``estimate`` measures every rule on a bounded sample:
its cost (seconds of a job that evaluates it alone, less those of a job that evaluates none) and its selectivity (share
of the sample it rejects). ``cascade`` puts the rules in the order of rejections per cost into one CASE expression:
Spark evaluates the branches one after the other and stops at the first that rejects. The order decides the cost alone;
a text is kept if no rule rejects it, so the verdicts do not depend on the sample.

Defined cases: null text has no words (n_words 0, all features 0) and fails the base rules, as does the empty text; a
text of any length is read whole; repeated rows get equal verdicts; an empty table gives an empty table (the rules then
keep the given order); columns beyond those named are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import saved, text_of

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Rows of the sample at most.
SAMPLE_ROWS = 2_000
WINDOW = 8

Rule = Callable[[Column], Column]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once: bound as the argument of a lambda over an array of one."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Runs of anything but white space."""
    inner = F.btrim(text, F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def word_chars(text: Column) -> Column:
    return without(text, SPACES).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - without(text, SYMBOLS)).cast("long")


def lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")


def n_dup_lines(text: Column) -> Column:
    return let(lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def repeat_words(parts: Column, window: int = WINDOW) -> Column:
    """Words (positions) inside windows of words that occur twice or more, the first occurrence included.

    A window is known by the 64-bit hash of its words' 64-bit hashes. Where two windows of a text are equal, (hash,
    position) pairs are sorted, those with an equal neighbour are kept, and the windows' union is measured in one pass.
    """

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            at,
            start,
            lambda acc, p: F.struct(
                (acc["n"] + p + F.lit(window) - F.greatest(p, acc["end"])).alias("n"), (p + F.lit(window)).alias("end")
            ),
            lambda acc: acc["n"].cast("long"),
        )

    def repeated(pairs: Column) -> Column:
        def twin(p: Column, k: Column) -> Column:
            before = F.get(pairs, k - 1)["h"]
            after = F.get(pairs, k + 1)["h"]
            return F.coalesce(p["h"] == before, F.lit(False)) | F.coalesce(p["h"] == after, F.lit(False))

        return F.array_sort(F.transform(F.filter(pairs, twin), lambda p: p["k"]))

    def of(hashes: Column) -> Column:
        keyed = F.array_sort(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            let(keyed, lambda pairs: covered(repeated(pairs)))
        )

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - F.lit(window - 1)), lambda k: F.xxhash64(F.slice(w, k, window)))

    return F.when(F.size(parts) < window + 1, F.lit(0).cast("long")).otherwise(
        let(F.transform(parts, lambda w: F.xxhash64(w)), lambda w: let(windows(w), of))
    )


def n_repeat_words(text: Column) -> Column:
    return let(words(text), repeat_words)


#: The base rules' features.
FEATURES: dict[str, Rule] = {
    "n_words": n_words,
    "word_chars": word_chars,
    "n_symbols": n_symbols,
    "n_dup_lines": n_dup_lines,
    "n_repeat_words": n_repeat_words,
}


def base_failed(n: Column, n_repeat: Column) -> Column:
    return (n < 20) | (100 * n_repeat > 30 * n)


def too_short(text: Column) -> Column:
    return n_words(text) < 20


def repetitive(text: Column) -> Column:
    return let(words(text), lambda w: 100 * repeat_words(w) > 30 * F.size(w))


def symbol_heavy(text: Column) -> Column:
    """More than one symbol to ten words."""
    return 10 * n_symbols(text) > n_words(text)


def duplicate_lines(text: Column) -> Column:
    """More than half of the lines with a word equal an earlier one."""
    return let(lines(text), lambda x: 2 * F.size(F.array_distinct(x)) < F.size(x))


def shouting(text: Column) -> Column:
    """More than 60 % of the ASCII letters are capitals."""
    return 5 * (F.length(text) - without(text, UPPER)) > 3 * (F.length(text) - without(text, UPPER + LOWER))


def word_length(text: Column) -> Column:
    """Words are of fewer than 2 or more than 15 code points in the mean."""
    return let(
        F.struct(word_chars(text).alias("c"), n_words(text).alias("n")), lambda x: (x["c"] < 2 * x["n"]) | (x["c"] > 15 * x["n"])
    )


#: The production rules.
RULES: dict[str, Rule] = {
    "too_short": too_short,
    "repetitive": repetitive,
    "symbol_heavy": symbol_heavy,
    "duplicate_lines": duplicate_lines,
    "shouting": shouting,
    "word_length": word_length,
}


def estimate(docs: DataFrame, rules: dict[str, Rule], rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, seconds, share rejected) on a sample of at most ``rows`` rows, best rejection per cost first."""
    n = docs.count()
    text = text_of().alias("text")
    picked = docs.select(text) if n <= rows else docs.select(text).sample(rows / n, seed=7).limit(rows)
    sample = saved(picked, "rule-sample")

    def job(measure: Column) -> tuple[float, float]:
        best, value = float("inf"), 0.0
        for _ in range(2):
            began = time.perf_counter()
            value = sample.agg(measure).first()[0] or 0.0
            best = min(best, time.perf_counter() - began)
        return best, value

    idle, _ = job(F.avg(F.length("text")))
    found = []
    for name, rule in rules.items():
        seconds, share = job(F.avg(rule(F.col("text")).cast("double")))
        found.append((name, max(seconds - idle, 1e-4), share))
    return sorted(found, key=lambda x: -x[2] / x[1])


def cascade(text: Column, rules: dict[str, Rule], order: list[str]) -> Column:
    """The first rule in this order that rejects the text, null if none does."""
    out = None
    for name in order:
        reject = rules[name](text)
        out = F.when(reject, F.lit(name)) if out is None else out.when(reject, F.lit(name))
    return out if out is not None else F.lit(None).cast("string")


def keep_good(docs: DataFrame, rules: dict[str, Rule] | None = None) -> DataFrame:
    """The rows of docs whose text no rule rejects, with their columns."""
    rules = RULES if rules is None else rules
    order = [name for name, *_ in estimate(docs, rules)]
    return docs.where(cascade(text_of(), rules, order).isNull())


def op4_quality_rules(docs: DataFrame) -> DataFrame:
    """Features of every document, the base verdict, and the cascade's verdict on those that pass it."""
    rules = {k: v for k, v in RULES.items() if k not in ("too_short", "repetitive")}  # these are the base rules
    order = [name for name, *_ in estimate(docs, rules)]
    text = text_of()
    featured = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("text"),
        let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("r"))).alias("w"),
        word_chars(text).alias("word_chars"),
        n_symbols(text).alias("n_symbols"),
        n_dup_lines(text).alias("n_dup_lines"),
    )
    failed = base_failed(F.col("w.n"), F.col("w.r"))
    return featured.select(
        "doc_id",
        F.col("w.n").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.col("w.r").alias("n_repeat_words"),
        failed.alias("base_failed"),
        F.when(failed, F.lit(False)).otherwise(cascade(F.col("text"), rules, order).isNull()).alias("kept"),
    )


#: DuckDB's form of the query.
ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), n AS (
  SELECT *, len(ws) AS n,
         list_transform(range(1, greatest(len(ws) - 6, 1)), lambda i: array_to_string(list_slice(ws, i, i + 7), ' ')) AS win
  FROM w
), d AS (
  SELECT doc_id, unnest(win) AS g, unnest(range(1, len(win) + 1)) AS k FROM n
), t AS (
  SELECT doc_id, k FROM d QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), c AS (
  SELECT doc_id, sum(least(8, coalesce(nx - k, 8))) AS r
  FROM (SELECT doc_id, k, lead(k) OVER (PARTITION BY doc_id ORDER BY k) AS nx FROM t) GROUP BY doc_id
), f AS (
  SELECT n.doc_id, n.text, CAST(n AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS nl,
         CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS al
  FROM n LEFT JOIN c ON n.doc_id = c.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (10 * n_symbols > n_words)
         AND NOT (2 * (nl - n_dup_lines) < nl) AND NOT (5 * up > 3 * al)
         AND NOT (word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM f
"""
