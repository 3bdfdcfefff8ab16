"""Measures made once, pairs of single-token groups, caches that keep frequent words, and worker tables given back."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from sparkdemand.llm import alignment, language, packing, quality
from sparkdemand.llm.common import Cache, add_missing, give_back
from sparkdemand.llm.words import words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_words_equal_pattern(docs):
    got = docs.select("text", words_of(F.col("text")).alias("w")).collect()
    assert len(got) == docs.count() and all(r.w == WORD.findall(r.text or "") for r in got)


def test_measured_rules_do_not_read_the_text_again(docs):
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(text.alias("text"), quality.measures(text).alias("m"))
    rules = [r for r in quality.METHOD_RULES if r.name != "capitals"]
    assert len(rules) == 3
    by_measures = quality.rejected_by(F.lit(None).cast("string"), rules, F.col("m"))
    got = rows.select(quality.rejected_by(F.col("text"), rules).alias("a"), by_measures.alias("b")).collect()
    assert {r.a for r in got} > {None} and all(r.a == r.b for r in got)


def test_pairs_of_groups_equal_counting():
    rnd = random.Random(8)
    sides = []
    for _ in range(2):
        sizes = [rnd.choice([1, 1, 1, 2, 5]) for _ in range(300)]
        sides.append((np.repeat(np.arange(300), sizes), np.array([rnd.randrange(4) for _ in range(sum(sizes))], dtype=np.int32)))
    want = Counter()
    for g in range(300):
        a, b = (Counter(ids[group == g].tolist()) for group, ids in sides)
        want.update({(g, x, y): k * n for x, k in a.items() for y, n in b.items()})
    got = list(zip(*(c.tolist() for c in alignment._paired(*sides[0], *sides[1])), strict=True))
    assert len(got) == len(want) and {r[:3]: r[3] for r in got} == want
    nothing = np.empty(0, np.int64)
    assert all(len(c) == 0 for c in alignment._paired(nothing, nothing, nothing, nothing))


def test_full_caches_keep_what_is_in_use():
    cache, made = Cache(), []

    def make(keys):
        made.extend(keys)
        return [k.upper() for k in keys]

    add_missing(cache, ["the", *map(str, range(10))], make, most=8)
    add_missing(cache, ["the", "new"], make, most=8)
    assert cache == {"the": "THE", "new": "NEW"} and made.count("the") == 1


def test_tables_of_other_steps_are_given_back(spark):
    packing.encoder_of(public_tokenizers.path("word_bpe_49k.json"))
    assert packing.encoder_of.cache_info().currsize == 1
    give_back()
    assert packing.encoder_of.cache_info().currsize == 0


def test_languages_of_a_large_batch_are_judged_in_slices(spark):
    texts = ["die und der das nicht", None, "the and of that is", ""] * 400
    df = spark.createDataFrame([(i, t, ["de", None, "en", None][i % 4]) for i, t in enumerate(texts)], "doc_id long, text string, lang string").coalesce(1)
    found = language.predict(df, language.fit(df))
    assert found.columns == [*df.columns, "lang_pred", "score"]
    got = {r.doc_id: r.lang_pred for r in found.collect()}
    assert got == {i: ["de", "und", "en", "und"][i % 4] for i in range(len(texts))}
