"""Every text operator against a brute-force version or its library, on edge cases, empty tables and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sparkdemand.llm import (
    fingerprints,
    language,
    near_dedup,
    packing,
    quality,
    sentence_pieces,
    sharding,
    suffix_dedup,
    token_counts,
    url_filter,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


def same(got, want):
    assert Counter(map(tuple, got)) == Counter(want)


# --- 1 near-dedup ---------------------------------------------------------------------------------


def shingle_set(text, size):
    words = WORD.findall(text.translate(UP))
    if len(words) < size:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute_groups(pairs, size, percent):
    sets = [shingle_set(t, size) for _, t in pairs]
    group = list(range(len(pairs)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                group[root(i)] = root(j)
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(pairs):
        ids[root(i)].append(doc_id)
    out = []
    for i, (doc_id, _) in enumerate(pairs):
        least = min((d for d in ids[root(i)] if d is not None), default=None) if sets[i] else doc_id
        out.append((doc_id, len(sets[i]), least, doc_id == least))
    return out


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_groups_equal_all_pairs(docs, size, percent):
    same(near_dedup.near_groups(docs, size=size, percent=percent).collect(), brute_groups(rows(docs), size, percent))


def test_near_groups_of_nothing(none):
    assert near_dedup.near_groups(none).count() == 0


def test_one_row_of_each_group_stays(docs):
    left = near_dedup.drop_near_copies(docs)
    want = {d for d, _, least, keep in brute_groups(rows(docs), 5, 80) if keep}
    # Two different texts stand under id 7, so ids alone do not tell how many rows stay; the next two tests do.
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == want


def test_no_text_is_lost_under_null_or_equal_ids(spark):
    base = [" ".join(f"{name}{i}" for i in range(60)) for name in "abcdef"]
    near = base[2].replace("c30", "other")
    pairs = [
        *[(None, base[0]), (None, base[1]), (None, base[1] + " "), (3, base[2]), (7, base[3]), (7, near), (7, base[4]), (9, base[4]), (None, base[4])],
        *[(5, base[5]), (5, base[5]), (None, None), (None, ""), (None, " \n"), (8, ""), (8, "")],
    ]
    df = spark.createDataFrame([(d, t, "s") for d, t in pairs], "doc_id long, text string, source string").repartition(3)
    left = near_dedup.drop_near_copies(df)
    # The two texts of the group of b are equal but for a space at the end; either may stand for it.
    got = Counter((r.doc_id, r.text and (r.text.rstrip(" ") if "b1" in r.text else r.text)) for r in left.collect())
    want = [(None, base[0]), (None, base[1]), (3, base[2]), (7, base[3]), (7, base[4]), (5, base[5])]
    assert left.columns == df.columns and got == Counter([*want, (None, None), (None, ""), (None, " \n"), (8, ""), (8, "")])


def test_each_group_keeps_one_of_its_texts(docs):
    """As above, on the fixture, with texts: each group of ``brute_groups`` has one row left, with its smallest id."""
    pairs = rows(docs)
    sets = [shingle_set(t, 5) for _, t in pairs]
    groups = brute_groups([(k, t) for k, (_, t) in enumerate(pairs)], 5, 80)
    allowed = defaultdict(set)
    for (doc_id, text), (_, _, group, _) in zip(pairs, groups, strict=True):
        allowed[group].add((doc_id, text))
    left = Counter(rows(near_dedup.drop_near_copies(docs)))
    assert left.total() == len(allowed)
    for group, members in allowed.items():
        least = min((d for d, _ in members if d is not None), default=None)
        stays = [left[m] for m in members if m[0] == least]
        assert sum(stays) == 1 and sum(left[m] for m in members) == 1 or not sets[group]


@pytest.mark.parametrize("seed", [1, 2])
def test_copies_around_the_threshold(spark, seed):
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(150)]
    family = [base, *[[f"v{i}" if rng.random() < 0.03 else w for i, w in enumerate(base)] for _ in range(3)]]
    texts = []
    for i in range(160):
        words = list(family[int(rng.integers(4))])
        for _ in range(int(rng.integers(1, 7))):
            words[int(rng.integers(len(words)))] = f"x{rng.integers(60 if i % 2 else 10**6)}"
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_groups(list(enumerate(texts)), 3, 85)
    assert 5 < len({w[2] for w in want}) < 155
    same(near_dedup.near_groups(df, size=3, percent=85).collect(), want)


@pytest.mark.parametrize("together", [2048, 7])
def test_large_buckets_are_compared_block_by_block(spark, monkeypatch, together):
    monkeypatch.setattr(near_dedup, "TOGETHER", together)
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(90):
        words = list(base)
        for _ in range(int(rng.integers(1, 5))):
            words[int(rng.integers(len(words)))] = f"x{rng.integers(10**6)}"
        texts.append(" ".join(words))
    want = brute_groups(list(enumerate(texts)), 3, 85)
    assert 3 < len({w[2] for w in want}) < 88
    same(near_dedup.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size=3, percent=85).collect(), want)


def test_bands_and_bounds():
    for t in (0.8, 0.85, 0.95):
        bands, size = near_dedup.bands_for(t)
        assert bands * size <= near_dedup.HASHES and (1 - t**size) ** bands <= near_dedup.MISS
    for n, least in near_dedup.least_matches(0.85):
        # A pair at the threshold is pruned with a small chance only.
        assert sum(math.comb(n, m) * 0.85**m * 0.15 ** (n - m) for m in range(least)) < 1e-4


# --- 2 url filter ---------------------------------------------------------------------------------

URLS = [
    None, "", "x", "http://NET/", "a://b.org/fr/x?y", "://.net/en/", "http://example.net", "http://w.EXAMPLE.net/en/://org/fr/",
    "http://a.example.net/en", "http://a.example.net/en/", "http://x.spam-farm.example.org/fr/", "http://xspam-farm.example.org\n/a",
    "http://cheap-pills.example.com/de/", "http://cheap-pills.example.com", "http://b.com/#://net/", "http://a..net//",
]


def test_url_filter_equals_sql(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS * 2)] + [(None, URLS[3], "y")], "page_id long, url string, host string")
    con = duckdb.connect()
    con.register("pages", pages.select("page_id", "url").toPandas().astype({"page_id": "Int64"}))
    cols = "page_id, host, path, rule, verdict"
    want = con.sql(f"SELECT {cols} FROM ({url_filter.FILTER_SQL})").fetchall()
    same(url_filter.filter_urls(pages).selectExpr(*cols.split(", ")).collect(), want)
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_cascade_is_exact_in_segments(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    universe = url_filter.kept(url_filter.hashed(keys))
    listed = url_filter.kept(url_filter.hashed(keys.where("substr(key, 2) % 7 = 0")))
    found = url_filter.with_listed(keys.select(F.array("key").alias("keys")), "keys", universe, listed, "hit", max_bytes=1000)
    assert all((int(r["keys"][0][1:]) % 7 == 0) == r["hit"][0] for r in found.collect())


def test_segments_follow_the_universe_too(spark):
    keys = spark.range(60000).select(F.concat(F.lit("k"), "id").alias("key"))
    universe = url_filter.kept(url_filter.hashed(keys))
    listed = url_filter.kept(url_filter.hashed(keys.where("substr(key, 2) % 1000 = 0")))
    # 60 listed keys, some 570 false positives of level 0: one segment of 300 bytes can't hold them.
    found = url_filter.with_listed(keys.select(F.array("key").alias("keys")), "keys", universe, listed, "hit", max_bytes=300)
    assert {r["keys"][0] for r in found.where("hit[0]").collect()} == {f"k{i}" for i in range(0, 60000, 1000)}


# --- 3 packing ------------------------------------------------------------------------------------


def test_packing_equals_library(docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path, length=64, with_ids=True).collect()
    want = Counter()
    for doc_id, text in rows(docs):
        ids = [*tok.encode(text, add_special_tokens=False).ids, 2]
        start = 0
        for n in packing.piece_lengths(len(ids), 64):
            raw = np.array(ids[start : start + n], dtype="<u4").tobytes()
            want[doc_id, start, n, zlib.crc32(raw), len(ids), tuple(ids[start : start + n])] += 1
            start += n
        assert start == len(ids)
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, tuple(r.ids)) for r in got) == want
    assert sorted(r.sequence_id for r in got) == list(range(len(got))) and {r.offset for r in got} == {0}
    assert [r.length for r in sorted(got, key=lambda r: r.sequence_id)] == sorted((r.length for r in got), reverse=True)
    assert packing.pack_documents(none, path).count() == 0


# --- 4 shards -------------------------------------------------------------------------------------


def test_shards_are_contiguous_and_even(docs, none, tmp_path, spark):
    got = sharding.shard_digest(docs, 5).collect()
    same([(r.doc_id, r.size, r.text_crc32) for r in got], [(d, len(t.encode()) + 16, zlib.crc32(t.encode())) for d, t in rows(docs)])
    slots, sizes, order = defaultdict(list), Counter(), defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        order[r.shard].append(-1 if r.doc_id is None else r.doc_id)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r.size for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * largest
    assert all(max(order[s]) <= min(order[s + 1]) for s in range(4))
    assert sharding.shard_digest(none).count() == 0
    sharding.write_shards(docs, str(tmp_path / "shards"), 5)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == len(got) and set(docs.columns) < set(back.columns)


# --- 5 language -----------------------------------------------------------------------------------


def test_language_by_family(spark, docs, none):
    made = {
        "en": "the thing that there with this and other shall ", "de": "der und nicht eine über schön ach wird ",
        "fr": "le été pour être nous avec dans où ", "es": "el año para ser con que señor más ",
    }
    data = [(i, " ".join(np.random.default_rng(i).permutation(t.split())), lang) for i, (lang, t) in enumerate(list(made.items()) * 60)]
    data += [(9001, None, "en"), (9002, "12 34", "en"), (9003, "the other thing", None), (None, "nous avec", None)]
    found = {r.doc_id: r for r in language.language_digest(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    held = [d for d in data if found[d[0]].held_out and d[2] and d[0] < 9000]
    assert held and sum(found[d[0]].lang_pred == d[2] for d in held) >= 0.98 * len(held)
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in found if i is not None)
    assert found[9001].lang_pred == found[9002].lang_pred == "und" and found[9001].score == 0 and found[9003].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in found.values())
    assert language.language_digest(none).count() == 0
    assert language.language_digest(docs).count() == docs.count()
    only = language.language_digest(docs.withColumn("lang", F.lit("en")))
    assert {(r.lang_pred, r.score) for r in only.collect()} == {("und", 0.0), ("en", 1.0)}


# --- 6 sentencepiece ------------------------------------------------------------------------------


def test_pieces_equal_library(docs, none):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = []
    for doc_id, text in rows(docs):
        ids = sp.encode(text)
        want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    same(sentence_pieces.encode_digest(docs, path).collect(), want)
    one = sentence_pieces.encode_texts(docs.where("doc_id = 0"), path).first()
    assert one.ids == sp.encode(one.decoded)
    assert sentence_pieces.encode_digest(none, path).count() == 0


# --- 7 fingerprints -------------------------------------------------------------------------------


def test_fingerprints(docs, none):
    got = fingerprints.fingerprint_digest(docs).collect()
    assert len(got) == docs.count() and fingerprints.fingerprint_digest(none).count() == 0
    texts = rows(docs)
    by_id = defaultdict(set)
    for d, t in texts:
        by_id[d].add(t)
    ids = sorted({d for d, _ in texts}, key=lambda d: (d is not None, d or 0))
    single = [d for d in ids if d is not None and len(by_id[d]) == 1]
    after = dict(zip(ids, [*ids[1:], ids[0]], strict=True))
    prints = {}
    errors = []
    for r in got:
        text = next((t for t in by_id[r.doc_id] if len(t) == r.n_chars), None)
        assert text is not None
        if r.doc_id in single and r.doc_id != 3 and len(by_id[after[r.doc_id]]) == 1:
            (following,) = by_id[after[r.doc_id]]
            k = len(text) // 2
            edited = text[: len(text) - k] + following[:k]
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert prints.setdefault(text, r.fingerprint) == r.fingerprint
            for other, near in ((edited, r.near_edited), (following, r.near_next)):
                a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in map(WORD.findall, (text, other)))
                errors.append(abs(near - (len(a & b) / len(a | b) if a | b else 1.0)))
    assert len(errors) > 50 and np.mean(errors) < 0.05 and max(errors) < 0.25
    assert all(r.fingerprint == "" for r in got if r.n_chars == 0)


# --- 8 quality ------------------------------------------------------------------------------------


def test_quality_equals_sql(docs, none):
    plain = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    con = duckdb.connect()
    con.register("documents", plain.select("doc_id", "text").toPandas())
    got = quality.quality_digest(plain)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({quality.QUALITY_SQL})").fetchall()
    same(got.collect(), want)
    assert quality.quality_digest(none).count() == 0 and quality.keep_good(none).count() == 0
    assert quality.quality_digest(docs).count() == docs.count()


def test_cascade_order_changes_nothing(docs):
    kept = quality.keep_good(docs)
    every = docs.where(quality.rejected_by(F.col("text"), quality.RULES[::-1]).isNull())
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, every.collect()))
    good = {r.doc_id for r in kept.collect()}
    digest = {r.doc_id for r in quality.quality_digest(docs).where("kept").collect()}
    assert good == digest


# --- 9 token counts -------------------------------------------------------------------------------


def test_counts_equal_library(docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    want = [(d, len(t.encode()), n := len(tok.encode(t).ids), n > 512) for d, t in rows(docs)]
    same(token_counts.count_tokens(docs, path).collect(), want)
    assert token_counts.count_tokens(none, path).count() == 0


# --- 10 suffix dedup ------------------------------------------------------------------------------


def brute_cut(pairs, length, keep_first):
    where = defaultdict(list)
    order = sorted(pairs, key=lambda r: (r[0] is not None, r[0] or 0))
    for k, (_, t) in enumerate(order):
        raw = t.encode()
        for i in range(len(raw) - length + 1):
            where[raw[i : i + length]].append((k, i))
    for k, (d, t) in enumerate(order):
        raw = t.encode()
        mask = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            found = where[raw[i : i + length]]
            if (found[0] != (k, i)) if keep_first else len(found) > 1:
                mask[i : i + length] = True
        yield d, raw, mask


@pytest.mark.parametrize("most", [4096, 2])
def test_repeats_equal_brute_force(docs, none, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST_RUNS", most)
    want = []
    for d, raw, mask in brute_cut(rows(docs), 400, False):
        rest = bytes(np.frombuffer(raw, np.uint8)[~mask])
        n = int((np.diff(np.r_[False, mask].astype(np.int8)) == 1).sum())
        want.append((d, len(raw), int(mask.sum()), n, hashlib.sha256(rest).hexdigest(), len(rest), rest.decode("utf-8", "ignore")))
    assert sum(w[2] for w in want) > 1000
    same(suffix_dedup.repeat_digest(docs).collect(), want)
    if most == 2:
        assert suffix_dedup.repeat_digest(none).count() == 0


@pytest.mark.parametrize("length", [200, 400])
def test_first_copy_stays(docs, length):
    plain = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    want = {d: bytes(np.frombuffer(raw, np.uint8)[~mask]).decode("utf-8", "ignore") for d, raw, mask in brute_cut(rows(plain), length, True)}
    left = suffix_dedup.cut_repeats(plain, length=length)
    assert left.columns == plain.columns and {r.doc_id: r.text or "" for r in left.collect()} == want


def test_longest_factors_equal_brute_force():
    rng = np.random.default_rng(0)
    for size in (20, 60, 110):
        b = rng.integers(0, 2, size).astype(np.uint8)
        raw, length = b.tobytes(), 16
        starts = np.arange(size - length + 1)
        earlier, later = suffix_dedup.longest_factors(b, starts, length)

        def common(i, j):
            return next(k for k in range(length, -1, -1) if raw[i : i + k] == raw[j : j + k])

        assert list(earlier) == [max([0, *(common(i, j) for j in range(i))]) // 8 * 8 for i in starts]
        assert list(later) == [max([0, *(common(i, j) for j in starts[i + 1 :])]) // 8 * 8 for i in starts]


# --- the pipeline ---------------------------------------------------------------------------------


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    left = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        made = stage(spark, left, str(tmp_path))
        assert made.columns == left.columns and dict(made.dtypes) == dict(left.dtypes)
        made.write.parquet(str(tmp_path / str(k)))
        left = spark.read.parquet(str(tmp_path / str(k)))
    assert 10 < left.count() < docs.count() and left.where("text IS NULL OR text = ''").isEmpty()
    packed = corpus_pipeline.run(spark, str(tmp_path))
    ends = packed.groupBy("doc_id").agg(F.max(F.col("start") + F.col("length")).alias("end"), F.first("doc_tokens").alias("n"))
    assert ends.where("end <> n").isEmpty() and ends.count() == left.count()
