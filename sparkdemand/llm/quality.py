"""Quality rules as a short-circuit cascade.

Each rule is an expression that says when a text is rejected.  On a sample of the documents every rule is timed and
its rejections counted; rules are then tried in the order of rejections per second, and a document leaves at the
first rule that rejects it.  The order decides only the speed: a document is kept if no rule rejects it.

Defined results: null and empty texts have no words and are rejected; repeated rows are judged alike; an empty table
gives no rows; other columns of the input pass through untouched in ``keep_good`` and are not read elsewhere.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdemand.llm.common import kept
from sparkdemand.llm.words import WORD, let, shingle_hashes, words_of

#: Rows of the sample on which costs and rejections are estimated.
SAMPLE_ROWS = 2000


def n_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def _chars(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w))


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))


def _repeats(words: Column, size: int = 3) -> Column:
    """Words inside runs of ``size`` words that the text holds twice or more, first places included.

    Equal runs become neighbours when (hash, place) is sorted; the places of repeated runs are then walked in text
    order, each adding the words up to the next one, ``size`` at most.
    """

    def neighbours(s: Column) -> Column:
        same = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
        return let(F.sort_array(F.transform(same, lambda x: x["p"])), covered)

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, i: F.least(F.lit(size), F.coalesce(F.get(places, i + 1) - p, F.lit(size))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, s: a + s)

    def counted(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(placed, neighbours)).otherwise(F.lit(0).cast("long"))

    return F.when(F.size(words) > size, let(shingle_hashes(words, size), counted)).otherwise(F.lit(0).cast("long"))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Column], Column]  # of the text, never null
    rejects_measured: Callable[[Column], Column] | None = None  # the same of a struct of the text's measures

    def judged(self, text: Column, measured: Column | None = None) -> Column:
        return self.rejects(text) if measured is None or self.rejects_measured is None else self.rejects_measured(measured)


def _few_words(text: Column) -> Column:
    return n_words(text) < 50


def _repetitive(text: Column) -> Column:
    return let(words_of(text), lambda w: 100 * _repeats(w) > 50 * F.size(w))


def _many_symbols(m: Column) -> Column:
    return 10 * m["n_symbols"] > m["n_words"]


def _symbols(text: Column) -> Column:
    return let(F.struct(n_symbols(text).alias("n_symbols"), n_words(text).alias("n_words")), _many_symbols)


def _odd_words(m: Column) -> Column:
    return (m["word_chars"] < 3 * m["n_words"]) | (m["word_chars"] > 12 * m["n_words"])


def _word_length(text: Column) -> Column:
    return let(let(words_of(text), lambda w: F.struct(_chars(w).alias("word_chars"), F.size(w).alias("n_words"))), _odd_words)


def _line_counts(text: Column) -> Column:
    return let(_lines(text), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("again")))


def _many_again(m: Column) -> Column:
    return 100 * m["lines"]["again"] > 30 * m["lines"]["n"]


def _lines_again(text: Column) -> Column:
    return let(F.struct(_line_counts(text).alias("lines")), _many_again)


def _capitals(text: Column) -> Column:
    return 100 * F.regexp_count(text, F.lit(r"\p{Lu}")) > 50 * F.regexp_count(text, F.lit(r"\p{L}"))


RULES = (
    Rule("few_words", _few_words),
    Rule("repeated_words", _repetitive),
    Rule("symbols", _symbols, _many_symbols),
    Rule("word_length", _word_length, _odd_words),
    Rule("repeated_lines", _lines_again, _many_again),
    Rule("capitals", _capitals),
)
#: The first two are the base that the query reports by itself.
METHOD_RULES = RULES[2:]


def ordered(
    docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, measured: bool = False
) -> list[Rule]:
    """The rules by rejections per second on a sample, best first; ``measured``: as they run where the measures are there."""
    n = docs.count()
    if n == 0 or len(rules) < 2:
        return list(rules)
    texts = docs.select(F.coalesce(text_col, F.lit("")).alias("text"))
    sample = texts.sample(min(1.0, sample_rows / n), seed=1) if n > sample_rows else texts
    sample = kept(sample.withColumn("m", measures(F.col("text"))) if measured else sample)

    def run(rejects: Column) -> tuple[float, int]:
        began = time.perf_counter()
        found = sample.agg(F.count_if(rejects)).first()[0]
        return time.perf_counter() - began, found

    run(F.col("text") == "")
    idle = run(F.col("text") == "")[0]
    worth = []
    for rule in rules:
        seconds, found = run(rule.judged(F.col("text"), F.col("m") if measured else None))
        worth.append((-found / max(seconds - idle, 1e-3), rule))
    return [rule for _, rule in sorted(worth, key=lambda x: x[0])]


def rejected_by(text: Column, rules: Sequence[Rule], measured: Column | None = None) -> Column:
    """Name of the first rule, in the given order, that rejects the text; later rules are not evaluated then.

    With ``measured``, the text's ``measures``, rules that need nothing else don't read the text again.
    """
    text = F.coalesce(text, F.lit(""))
    cases = F.when(rules[0].judged(text, measured), rules[0].name)
    for rule in rules[1:]:
        cases = cases.when(rule.judged(text, measured), rule.name)
    return cases


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """The documents that no rule rejects, with all their columns."""
    return docs.where(rejected_by(F.col(text_col), ordered(docs, rules, text_col)).isNull())


def measures(text: Column) -> Column:
    """The numbers that the digest reports, and the lines that they are about; the words are made once."""
    return let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            _chars(w).alias("word_chars"),
            n_symbols(text).alias("n_symbols"),
            _line_counts(text).alias("lines"),
            _repeats(w).alias("n_repeat_words"),
        ),
    )


def quality_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept``."""
    rules = ordered(docs.select(text_col), METHOD_RULES, text_col, measured=True)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    base = (F.col("m.n_words") < 50) | (100 * F.col("m.n_repeat_words") > 50 * F.col("m.n_words"))
    # The numbers are made once per row and pass through a generator, so that nothing evaluates them again.
    rows = docs.select("doc_id", "text", F.explode(F.array(measures(F.col("text")))).alias("m"))
    return rows.select(
        "doc_id",
        "m.n_words",
        "m.word_chars",
        "m.n_symbols",
        F.col("m.lines.again").alias("n_dup_lines"),
        "m.n_repeat_words",
        base.alias("base_failed"),
        F.when(base, F.lit(False)).otherwise(rejected_by(F.col("text"), rules, F.col("m")).isNull()).alias("kept"),
    )


#: The same in SQL; the order of the rules does not matter for the result.
QUALITY_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l
  FROM documents
), runs AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS run
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS n FROM runs) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), m AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines,
    coalesce(covered.n, 0) AS n_repeat_words, len(regexp_extract_all(t, '\p{Lu}')) AS upper, len(regexp_extract_all(t, '\p{L}')) AS letters
  FROM d LEFT JOIN covered USING (doc_id)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 3 * n_words OR word_chars > 12 * n_words
    OR 100 * n_dup_lines > 30 * n_lines OR 100 * upper > 50 * letters) AS kept
FROM b
"""
