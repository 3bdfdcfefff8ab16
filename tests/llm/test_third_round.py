"""Alignment, substring dedup and centroids against brute force, on edge cases, empty tables and clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sparkdemand.llm import alignment, centroids, packing, sentence_pieces, substring_dedup, token_counts
from sparkdemand.llm.common import Cache, add_missing

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def rows(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


def same(got, want):
    assert Counter(map(tuple, got)) == Counter(want)


# --- 11 alignment -----------------------------------------------------------------------------------


def groups_of(a, b, size_a, size_b):
    """Groups of two token lists, walked along both."""
    out, i, j, end_a, end_b = [], 0, 0, 0, 0
    left, right = [], []
    while i < len(a) or j < len(b):
        if end_a <= end_b and i < len(a):
            left.append(a[i])
            end_a += size_a[a[i]]
            i += 1
        else:
            right.append(b[j])
            end_b += size_b[b[j]]
            j += 1
        if end_a == end_b and left and right:
            out.append((left, right))
            left, right = [], []
    return out


def brute_alignment(pairs):
    import sentencepiece
    from tokenizers import Tokenizer

    tok, sp, vocab = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), alignment.Pair(A, B)
    tok.encode_special_tokens = True
    found, counts = [], Counter()
    for d, t in pairs:
        a = tok.encode(" " + t, add_special_tokens=False).ids if t else []
        b = sp.encode(t) if t else []
        raw = (" " + t).encode()
        if b"".join(vocab.bytes_a[i] for i in a) != raw or b"".join(vocab.bytes_b[i] for i in b) != raw:
            a, b = [], []
        groups = groups_of(a, b, vocab.sizes_a, vocab.sizes_b)
        links = Counter((x, y) for left, right in groups for x in left for y in right)
        counts.update(links.keys())
        text = ";".join(f"{','.join(map(str, left))}|{','.join(map(str, right))}" for left, right in groups)
        found.append((d, len(a), len(b), len(groups), links, hashlib.sha256(text.encode()).hexdigest() if a else ""))
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for d, na, nb, ng, links, digest in found:
        best = sum(n for p, n in links.items() if counts[p] == most[p[0]])
        out.append((d, na, nb, ng, links.total(), best, sum(n * counts[p] for p, n in links.items()), digest))
    return out, counts


@pytest.mark.parametrize("block", [1 << 21, 300])
def test_alignment_equals_brute_force(docs, none, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK", block)  # blocks of many texts, and of one or two
    want, counts = brute_alignment(rows(docs))
    got, pairs = alignment.align(docs, A, B)
    same(got.collect(), want)
    assert {(r.a, r.b): r["count"] for r in pairs.collect()} == dict(counts)
    assert alignment.align_digest(none, A, B).count() == 0
    assert any(w[1] == 0 and w[0] is not None for w in want) and max(w[4] - w[3] for w in want) > 10


def test_alignment_of_very_long_texts(spark):
    texts = ["z" * 30000, "né日本" * 8000, "one two  three " * 20000, "a b c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    same(alignment.align_digest(df, A, B).collect(), brute_alignment(list(enumerate(texts)))[0])


# --- 12 substring dedup -----------------------------------------------------------------------------


def brute_words(pairs, window):
    """Documents (equal id and text: one) in order, each with the mask of its covered words."""
    order = sorted(set(pairs), key=lambda p: (p[0] is not None, p[0] or 0))
    first, masks = {}, {}
    for k, (d, t) in enumerate(order):
        words = WORD.findall(t.encode())
        mask = np.zeros(len(words), bool)
        for i in range(len(words) - window + 1):
            own = tuple(words[i : i + window])
            if first.setdefault(own, (k, i)) != (k, i):
                mask[i : i + window] = True
        masks[d, t] = words, mask
    return masks


def digest_of(d, words, mask):
    rest = [w for w, m in zip(words, mask, strict=True) if not m]
    raw = b" ".join(rest)
    return d, len(words), int(mask.sum()), hashlib.sha256(raw).hexdigest(), len(rest), raw.decode()


def ordered_ids(docs):
    """Without different texts under one id, whose order follows a hash."""
    return docs.where("NOT (doc_id <=> 7 AND text LIKE 'other%') AND doc_id IS NOT NULL")


@pytest.mark.parametrize("window,gram", [(20, 4), (6, 3)])
def test_repeated_words_equal_brute_force(docs, none, window, gram):
    plain = ordered_ids(docs)
    masks = brute_words(rows(plain), window)
    want = [digest_of(d, *masks[d, t]) for d, t in rows(plain)]
    assert sum(w[2] for w in want) > 500
    same(substring_dedup.repeat_words_digest(plain, window=window, gram=gram).collect(), want)
    assert substring_dedup.repeat_words_digest(none).count() == 0 and substring_dedup.cut_repeated_words(none).count() == 0
    # Null ids and several texts under one id go through as well.
    assert substring_dedup.repeat_words_digest(docs).count() == docs.count()


def test_parts_of_hot_minimisers_and_runs_of_one_word(spark):
    rnd = random.Random(4)
    shared = [f"s{i}" for i in range(60)]
    texts = []
    for i in range(300):
        own = [f"w{rnd.randrange(500)}" for _ in range(40)]
        texts.append(" ".join(own[:20] + shared[i % 7 : 40 + i % 9] + own[20:]))
    texts += ["x " * 900, "x " * 500 + "y " * 30, "a b c " * 40, texts[5], texts[5], "  \n" + texts[6]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    masks = brute_words(list(enumerate(texts)), 20)
    same(substring_dedup.repeat_words_digest(df).collect(), [digest_of(d, *masks[d, t]) for d, t in enumerate(texts)])
    _, m, _, _, w = substring_dedup.super_kmers([substring_dedup.words_of(t) for t in texts])
    assert Counter(m.tolist()).most_common(1)[0][1] > w.sum() // (4 * 8)  # so some are dealt into parts


def test_pieces_of_long_texts_change_nothing(spark, monkeypatch):
    rnd = random.Random(5)
    passage = [f"p{i}" for i in range(50)]
    long = [f"w{rnd.randrange(300)}" for _ in range(4000)] + passage + [f"w{i}" for i in range(2000)] + passage
    texts = [" ".join(long), " ".join(passage), " ".join(long[3000:])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = substring_dedup.repeat_words_digest(df).collect()
    monkeypatch.setattr(substring_dedup, "PIECE", 64)
    monkeypatch.setattr(substring_dedup, "BLOCK", 100)
    same(substring_dedup.repeat_words_digest(df).collect(), list(map(tuple, whole)))
    masks = brute_words(list(enumerate(texts)), 20)
    same(whole, [digest_of(d, *masks[d, t]) for d, t in enumerate(texts)])


def test_full_filter_changes_nothing(docs, monkeypatch):
    want = list(map(tuple, substring_dedup.repeat_words_digest(docs).collect()))
    monkeypatch.setattr(substring_dedup, "FILTER_BITS", 64)
    same(substring_dedup.repeat_words_digest(docs).collect(), want)


def test_cut_texts_keep_columns(docs):
    plain = ordered_ids(docs).dropDuplicates(["doc_id"])
    masks = brute_words(rows(plain), 20)
    left = substring_dedup.cut_repeated_words(plain)
    assert left.columns == plain.columns
    for r in left.collect():
        before = next(t for d, t in masks if d == r.doc_id)
        words, mask = masks[r.doc_id, before]
        assert (r.text or "") == (digest_of(0, words, mask)[5] if mask.any() else before)


# --- 13 centroids -----------------------------------------------------------------------------------


def brute_clusters(pairs, k=8, rounds=10, dims=64):
    """Plain integers: every vector against every centroid."""
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in pairs if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cents = [v for _, v in start[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cents))

    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        cents = [[sum(col) // len(own[n]) for col in zip(*own[n], strict=True)] if own[n] else c for n, c in enumerate(cents)]
    placed = [(i, *nearest(v)) for i, v in kept]
    sums = Counter()
    for _, d, n in placed:
        sums[n] += d
    return [(i, n, d, sums[n], sums.total(), hashlib.sha256(",".join(map(str, cents[n])).encode()).hexdigest()) for i, d, n in placed]


def vectors(n=120, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, 64))
    out = [(i, (centres[rng.integers(5)] + 0.3 * rng.normal(size=64)).tolist()) for i in range(n)]
    same_as = out[3][1]
    out += [(n, same_as), (n + 1, same_as), (3, same_as), (n + 2, [0.0] * 64), (n + 3, [-0.0004] * 64)]
    bad = [None, [], [1.0] * 63, [1.0] * 65, [None] + [1.0] * 63, [float("nan")] * 64, [float("inf")] + [0.0] * 63]
    return out, [(900 + i, v) for i, v in enumerate(bad)]


SCHEMA = "vec_id long, embedding array<double>, cluster int, distance string, v string, c int, x string"


def frame(spark, pairs):
    return spark.createDataFrame([(i, v, 1, "d", "v", 2, "x") for i, v in pairs], SCHEMA).repartition(3)


def test_clusters_equal_brute_force(spark):
    good, bad = vectors()
    got = centroids.cluster_digest(frame(spark, good + bad))
    want = brute_clusters(good + bad)
    assert len({w[1] for w in want}) > 3
    same(got.collect(), want)


def test_clusters_equal_sql(spark):
    good, bad = vectors(60, 7)
    df = frame(spark, dict(good).items())
    con = duckdb.connect()
    con.register("embeddings", df.select("vec_id", "embedding").toPandas())
    got = centroids.cluster_digest(df)
    same(got.collect(), con.sql(f"SELECT {', '.join(got.columns)} FROM ({centroids.CLUSTER_SQL})").fetchall())


def test_few_vectors_no_vectors_and_huge_components(spark):
    good, bad = vectors(9)
    few = good[:3]
    same(centroids.cluster_digest(frame(spark, few)).collect(), brute_clusters(few))
    assert centroids.cluster_digest(frame(spark, bad)).count() == 0
    assert centroids.cluster_digest(frame(spark, good).limit(0)).count() == 0
    assert centroids.cluster_digest(frame(spark, [(None, good[0][1])])).count() == 0
    huge = centroids.cluster_digest(frame(spark, [*few, (77, [1e300] * 64), (78, [-1e300] * 64)])).collect()
    assert len(huge) == 5 and all(0 <= r.distance <= 64 * (2 * centroids.MOST) ** 2 for r in huge)
    without_id = centroids.cluster_digest(frame(spark, [*few, (None, good[5][1])])).collect()
    assert len(without_id) == 4 and {r.cluster for r in without_id} <= {0, 1, 2}


def test_search_breaks_ties_by_number():
    rng = np.random.default_rng(2)
    cents = rng.integers(-3, 4, size=(9, 4))
    cents[5] = cents[2]
    points = rng.integers(-4, 5, size=(400, 4))
    who, best = centroids.search(points, cents)
    full = ((points[:, None] - cents[None]) ** 2).sum(axis=2)
    assert (who == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all()


# --- word caches ------------------------------------------------------------------------------------


def test_caches_hold_short_keys_only():
    cache = Cache()
    add_missing(cache, ["a", "b" * 100], lambda new: [len(k) for k in new])
    assert cache == {"a": 1, "b" * 100: 100}
    add_missing(cache, ["c"], lambda new: [len(k) for k in new], most=1)
    assert cache == {"a": 1, "c": 1}
    add_missing(cache, ["d"], lambda new: [len(k) for k in new], most=1)
    assert cache == {"d": 1}


def test_packing_ids_equal_library_on_random_characters():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, tok, rnd = packing.Encoder(path), Tokenizer.from_file(path), random.Random(1)
    chars = [*map(chr, range(32, 127)), *map(chr, range(0xC0, 0x180)), *" \t\n\r\x0b\x0c" * 6, *"'sStrevmMdDlL" * 6]
    odd = [*"İ日́\x1c\xa0½²×ﬁΣ", "<|endoftext|>", "<|startoftext|>"]
    texts = ["".join(rnd.choice(chars + odd * (i % 2)) for _ in range(rnd.randrange(60))) for i in range(4000)]
    texts += [f"a{chr(c)}B'S" for c in range(32, 0x300)]
    want = [np.array(tok.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert encoder.block(texts) == want


def test_long_words_are_not_kept():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, counter, codec = packing.Encoder(path), token_counts.Counter(A), sentence_pieces.Codec(B)
    for worker in (encoder, counter, codec):
        list(worker.block(["x" * 5000 + " short"]))
        list(worker.block(["short"]))
    kept = [*encoder.cache, *counter.heads, *counter.tails, *counter.merger.words, *codec.cache, *codec.model.found]
    assert kept and max(map(len, kept)) <= 65


def test_megabytes_in_one_text(spark):
    """Very long texts, one of them without a space, through the operators of whole texts."""
    rnd = random.Random(6)
    texts = [" ".join(f"w{rnd.randrange(9000)}" for _ in range(300_000)), "q" * 2_000_000, "short text"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.repeat_words_digest(df).collect()}
    assert counts == {0: (300_000, 0), 1: (1, 0), 2: (2, 0)}
    ends = packing.pack_documents(df, public_tokenizers.path("word_bpe_49k.json")).groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t"))
    assert all(r.n == r.t for r in ends.collect())
