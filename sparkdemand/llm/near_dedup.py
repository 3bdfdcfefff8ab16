"""Near duplicates: MinHash bands, sequential Bayesian pruning, exact confirmation.

1. Tasks turn each text into its set of word shingles (64-bit hashes), a signature of 384 minimum hashes, the hashes
   of its bands and a 128-bit hash of the set.  Documents with equal sets form a class at once.
2. Classes that share a band are candidates.  First every class of a bucket is compared with one centre of it, which
   links groups of copies with as many pairs as members.
3. Signatures of a pair are compared in batches.  After each batch the posterior chance that the similarity reaches
   the threshold (uniform prior, matches counted on 8 bits) is bounded; below ``MISS`` the pair is dropped.
4. What survives is confirmed on the full sets; links give components.
5. Buckets that still hold several components come to tasks with their signatures and sets.  There members of
   different components are compared in the same way, each pair in the first band that it shares, and only links that join
   components come out, so no pair is ever a row.  Buckets of more than ``TOGETHER`` members are compared block by block.

Bands are chosen so that a pair right at the threshold shares none with a chance below ``MISS``.

Defined results: a text that is null, empty or without words has an empty set and is linked with nothing; fewer words
than a shingle are one shingle; repeated rows and equal ids are rows of one class; a component's id is its smallest
doc_id that is not null (null if there is none); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdemand.llm.bloom import may_be_in
from sparkdemand.llm.common import kept, slices
from sparkdemand.llm.components import components

HASHES = 384
COMPARED = 128
BATCH = 32
MISS = 1e-6
#: Members of a bucket that one task compares with each other; larger buckets are cut into blocks, one task per pair of blocks.
TOGETHER = 2048
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: float, hashes: int = HASHES, miss: float = MISS) -> tuple[int, int]:
    """(bands, rows): the longest bands that still lose a pair at the threshold with a chance below ``miss``."""
    for rows in range(32, 0, -1):
        if hashes // rows and (1 - threshold**rows) ** (hashes // rows) <= miss:
            return hashes // rows, rows
    return hashes, 1


@lru_cache(maxsize=4)
def least_matches(threshold: float, compared: int = COMPARED, batch: int = BATCH, miss: float = MISS) -> tuple[tuple[int, int], ...]:
    """(signatures compared, fewest matches with which a pair may still reach the threshold) for each batch."""
    grid = np.linspace(0, 1, 4001)
    p = grid + (1 - grid) / 256
    bounds = []
    for n in range(batch, compared + 1, batch):
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log(np.maximum(1 - p, 1e-300))
            posterior = np.exp(log - log.max())
            if posterior[grid >= threshold].sum() >= miss * posterior.sum():
                bounds.append((n, m))
                break
    return tuple(bounds)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of shingle hashes; words are hashed once per task."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.cache: dict[bytes, int] = {}

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the shingles of a text."""
        words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
        if len(words) < self.size:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))] if words else [], dtype=np.uint64)
        cache = self.cache
        if len(cache) > 300_000:  # of at most 64 bytes each
            cache.clear()
        try:
            hashes = [cache[w] for w in words]
        except KeyError:
            hashes = []
            for w in words:
                h = cache.get(w)
                if h is None:
                    h = xxhash.xxh3_64_intdigest(w)
                    if len(w) <= 64:
                        cache[w] = h
                hashes.append(h)
        w = np.array(hashes, dtype=np.uint64)
        n = len(w) - self.size + 1
        h = w[:n].copy()
        for k in range(1, self.size):
            h = _mix(h + _M3) + w[k : n + k]
        return np.unique(_mix(h))


class Signer:
    def __init__(self, size: int, threshold: float) -> None:
        self.bands, self.rows = bands_for(threshold)
        numbers = np.random.default_rng(7)
        self.a = numbers.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
        self.b = numbers.integers(0, 1 << 32, HASHES, dtype=np.uint32)
        self.own = _mix(np.arange(1, self.bands + 1, dtype=np.uint64))
        self.shingler = Shingler(size)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        for i in range(0, len(x), 1024):
            made = np.multiply.outer(self.a, x[i : i + 1024])
            made += self.b[:, None]
            np.minimum(least, made.min(axis=1), out=least)
        return least

    def band_hashes(self, signature: np.ndarray) -> np.ndarray:
        rows = signature[: self.bands * self.rows].reshape(self.bands, self.rows).astype(np.uint64)
        h = self.own.copy()
        for k in range(self.rows):
            h = _mix(h + _M3) + rows[:, k]
        return _mix(h).view(np.int64)


def sign(docs: DataFrame, id_col: str, text_col: str, size: int, threshold: float) -> DataFrame:
    """``doc_id, at, t, n, c1, c2, bands, sig`` for each row; ``t`` is a hash of the text."""
    names = ["doc_id", "at", "t", "n", "c1", "c2", "bands", "sig"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(size, threshold)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                n, c1, c2, bands, sigs = [], [], [], [], []
                for text in part.column(1):
                    shingles = signer.shingler.shingles(text.as_py())
                    n.append(len(shingles))
                    whole = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), dtype=np.int64)
                    c1.append(whole[0])
                    c2.append(whole[1])
                    signature = signer.signature(shingles) if len(shingles) else None
                    bands.append(None if signature is None else signer.band_hashes(signature))
                    sigs.append(None if signature is None else signature[:COMPARED].astype(np.uint8).tobytes())
                longs = [pa.array(np.array(x, dtype=np.int64)) for x in (n, c1, c2)]
                arrays = [part.column(0), part.column(2), part.column(3), *longs, pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names)

    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("at"), F.xxhash64(text_col).alias("t")
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, at long, t long, n long, c1 long, c2 long, bands array<long>, sig binary")


def prune(pairs: DataFrame, signatures: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``a, b`` that may reach the threshold, judged by set sizes and signature batches."""
    bounds = least_matches(threshold)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = np.arange(batch.num_rows)
            sa, sb = (
                np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(-1, COMPARED) for i in (2, 3)
            )
            same = np.zeros(len(left), dtype=np.int64)
            done = 0
            for n, least in bounds:
                same[left] += (sa[left, done:n] == sb[left, done:n]).sum(axis=1)
                left, done = left[same[left] >= least], n
            yield batch.select([0, 1]).take(pa.array(left))

    def side(s: str) -> DataFrame:
        return signatures.select(F.col("at").alias(s), F.col("n").alias(f"n{s}"), F.col("sig").alias(f"s{s}"))

    sized = F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9
    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(sized)
    return joined.select("a", "b", "sa", "sb").mapInArrow(work, "a long, b long")


def with_texts(pairs: DataFrame, docs: DataFrame, signatures: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``a, b, ta, tb``: the texts of both sides of each pair, rows of one ``a`` mostly together."""
    pairs = kept(pairs)
    wanted = pairs.select(F.col("a").alias("at")).union(pairs.select(F.col("b").alias("at"))).distinct()
    wanted = kept(wanted.join(signatures.select("at", "doc_id", "t"), "at"))
    texts = docs.select(F.col(id_col).alias("id__"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t"))
    # Only texts that may be wanted are shuffled.
    texts = texts.where(may_be_in("t", wanted)).withColumnRenamed("t", "t__")
    # Rows that repeat an id and a text are the same text; one of them is enough.
    texts = kept(
        texts.join(wanted, F.col("id__").eqNullSafe(F.col("doc_id")) & (F.col("t__") == F.col("t")))
        .select("at", "text")
        .dropDuplicates(["at"])
    )

    def side(s: str) -> DataFrame:
        return texts.select(F.col("at").alias(s), F.col("text").alias(f"t{s}"))

    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ta", "tb")


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[np.ndarray, np.ndarray]]]]:
    """Each batch of ``with_texts`` with the two shingle sets of its rows."""
    shingler = Shingler(size)
    last, left = None, np.empty(0, np.uint64)
    for batch in slices(batches):
        sets = []
        for a, ta, tb in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
            if a != last:
                last, left = a, shingler.shingles(ta.as_py())
            sets.append((left, shingler.shingles(tb.as_py())))
        yield batch, sets


def confirm(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold: 100 * intersection >= percent * union."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches, size):
            keep = []
            for x, y in sets:
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return texts.mapInArrow(work, "a long, b long")


def settle(key: int, nodes: np.ndarray, comps: np.ndarray, sides: np.ndarray, bands: np.ndarray, sigs: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join components among the members of one bucket (``key``).

    ``sides`` are the blocks of the members: if there are two, only members of different blocks are compared.
    """
    threshold = percent / 100
    bounds = least_matches(threshold)
    sizes = np.array([len(s) for s in sets])
    label = np.unique(comps, return_inverse=True)[1]
    main = np.bincount(label).argmax()  # its members are compared with all others, so it needs no turn of its own
    mine, crossed = label == main, len(np.unique(sides)) > 1
    links = []
    for x in np.flatnonzero(~mine).tolist():
        left = (label != label[x]) & (mine | (np.arange(len(nodes)) < x))
        left &= np.minimum(sizes, sizes[x]) >= threshold * np.maximum(sizes, sizes[x]) - 1e-9
        if crossed:
            left &= sides != sides[x]
        left = np.flatnonzero(left)
        shared = bands[left] == bands[x]
        left = left[bands[x][shared.argmax(axis=1)] == key]  # pairs of an earlier band are compared there
        same, done = np.zeros(len(left), dtype=np.int64), 0
        for n, least in bounds:
            same += (sigs[left, done:n] == sigs[x, done:n]).sum(axis=1)
            left, same, done = left[same >= least], same[same >= least], n
        if not len(left):
            continue
        own, joined = sets[x], np.concatenate([sets[y] for y in left])
        at = np.minimum(np.searchsorted(own, joined), len(own) - 1)
        both = np.add.reduceat(own[at] == joined, np.cumsum(sizes[left]) - sizes[left], dtype=np.int64)
        for y in left[100 * both >= percent * (sizes[x] + sizes[left] - both)].tolist():
            if label[y] != label[x]:
                links.append((int(nodes[x]), int(nodes[y])))
                label[label == label[y]] = label[x]
    return links


def links_between(members: DataFrame, labels: DataFrame, signatures: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """Links ``a, b`` between members of one bucket that lie in different components."""
    placed = members.join(labels, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
    placed = kept(placed.join(mixed.select("key", "n"), "key"))
    wanted = kept(placed.select(F.col("node").alias("at")).distinct().join(signatures.select("at", "doc_id", "t", "bands", "sig"), "at"))
    texts = docs.select(F.col(id_col).alias("id__"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t"))
    # Only texts that may be wanted are shuffled; rows that repeat an id and a text are the same text.
    texts = texts.where(may_be_in("t", wanted.select("t"))).withColumnRenamed("t", "t__")
    found = texts.join(wanted, F.col("id__").eqNullSafe(F.col("doc_id")) & (F.col("t__") == F.col("t"))).dropDuplicates(["at"])

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in slices(batches):
            sets = pa.array([shingler.shingles(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), sets], ["node", "bands", "sig", "shingles"])

    sets = kept(found.select("at", "text", "bands", "sig").mapInArrow(shingled, "node long, bands array<long>, sig binary, shingles binary"))
    blocks = F.ceil(F.col("n") / TOGETHER).cast("int")
    side = F.pmod(F.xxhash64("node"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(side, j).alias("i"), F.greatest(side, j).alias("j")))
    dealt = placed.select("key", "node", "comp", side.alias("side"), F.explode(pairs).alias("p"))
    dealt = dealt.join(sets, "node").select("key", "p.i", "p.j", "node", "comp", "side", "bands", "sig", "shingles")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: list[dict]) -> list[tuple[int, int]]:
            nodes, comps, sides = (np.array([r[c] for r in rows], dtype=np.int64) for c in ("node", "comp", "side"))
            bands = np.array([r["bands"] for r in rows], dtype=np.int64)
            sigs = np.frombuffer(b"".join(r["sig"] for r in rows), dtype=np.uint8).reshape(-1, COMPARED)
            shingles = [np.frombuffer(r["shingles"], dtype=np.uint64) for r in rows]
            return settle(rows[0]["key"], nodes, comps, sides, bands, sigs, shingles, percent)

        def batch_of(links: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

        held: list[dict] = []
        for batch in batches:
            found = []
            for start in range(0, batch.num_rows, 256):
                for row in batch.slice(start, 256).to_pylist():
                    if held and any(held[0][c] != row[c] for c in ("key", "i", "j")):
                        found += solve(held)
                        held = []
                    held.append(row)
            yield batch_of(found)
        if held:
            yield batch_of(solve(held))

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node").mapInArrow(work, "a long, b long")


def near_rows(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """``doc_id, t, n, comp, component_id`` for every row; ``comp`` is a number of the group, null for a text without words."""
    threshold = percent / 100
    signed = kept(sign(docs, id_col, text_col, size, threshold))
    filled = signed.where("n > 0")
    classes = kept(filled.groupBy("c1", "c2").agg(F.min("at").alias("node"), F.min("doc_id").alias("rep")))
    banded = filled.join(classes.select(F.col("node").alias("at")), "at").select(F.col("at").alias("node"), F.explode("bands").alias("key"))
    centres = banded.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where("centre < last").drop("last")
    members = kept(banded.join(centres, "key").select("key", "node", "centre"))
    stars = kept(members.where("node > centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct())
    first = kept(confirm(with_texts(prune(stars, filled, threshold), docs, filled, id_col, text_col), size, percent))
    labels = components(first)
    more = kept(links_between(members.select("key", "node"), labels, filled, docs, id_col, text_col, size, percent))
    if not more.isEmpty():
        labels = components(kept(first.union(more)))
    placed = classes.join(labels, "node", "left").select("c1", "c2", "rep", F.coalesce("comp", "node").alias("comp"))
    least = placed.groupBy("comp").agg(F.min("rep").alias("component_id"))
    placed = placed.join(least, "comp").select("c1", "c2", "comp", "component_id")
    columns = ["doc_id", "t", "n", "comp", "component_id"]
    grouped = filled.select("doc_id", "t", "n", "c1", "c2").join(placed, ["c1", "c2"]).select(*columns)
    alone = signed.where("n = 0").withColumns({"comp": F.lit(None).cast("long"), "component_id": F.col("doc_id")}).select(*columns)
    return grouped.union(alone)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row."""
    return near_rows(docs, id_col, text_col, size, percent).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group, with all its columns: one with the smallest doc_id (null if the group has no other).

    Of different texts of a group under that id the one with the least hash stays.  Groups are told apart by their texts, not
    by ids: different texts under one id, or under none, stay.  Rows without words are in no group and all stay.
    """
    rows = near_rows(docs, id_col, text_col, size, percent)
    first = rows.where("n > 0 AND doc_id <=> component_id").groupBy("comp", "component_id").agg(F.coalesce(F.min("t"), F.lit(0)).alias("t"))
    # In a struct null ids are equal; with ``t`` never null on both sides, the join and the reduction share one shuffle.
    keep = first.select(F.struct(F.col("component_id").alias("id"), "t").alias("k__"))
    worded = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = docs.where(worded).withColumn("k__", F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t")))
    one = keyed.join(keep, "k__", "left_semi").dropDuplicates(["k__"]).select(*docs.columns)
    return one.union(docs.where(~worded))


#: The rows of the query in SQL: shingles of three words, links at 85 %, every link followed.
NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS shingle FROM w)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n AS p ON p.doc_id = a JOIN n AS q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)
), reach AS (
  SELECT doc_id, doc_id AS other FROM w UNION SELECT doc_id, b FROM reach JOIN links ON other = a
), c AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM w JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
