"""URL filters with Bloom filter cascades: exact membership without joins.

A cascade answers whether a key of a known universe is listed.  Level 0 is a Bloom filter of the listed keys; level 1
holds the other keys of the universe that level 0 lets through by mistake; level 2 the listed keys that level 1 lets
through, and so on until nobody is left.  A key is listed if the first level that does not know it has an odd number.
The universe is the complete set of keys of the corpus, so no answer is wrong.

Bits are set by Spark (one row per 64-bit word) and the words of one level go to all tasks.  Their size follows the
number of listed keys and of keys that level 0 is expected to let through by mistake: keys are split by hash into as many segments as it takes to keep the
words of one segment below ``MAX_WORD_BYTES``; segments are built and probed one after the other, and what has been
answered is written down in between.

Keys of a url: every parent domain of its host, alone (host lists) and with the path prefixes that have the length of
a rule's path.  The longest rule wins; of two of equal length the one with the longer host.

Defined results: a null url, or one without ``://``, has an empty host and path and no rule; without a rule a url is
blocked if its host or a parent domain is listed, else allowed; repeated rows give repeated rows; an empty table or an
empty list is allowed; other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdemand.llm.bloom import BITS_PER_KEY, HASHES, bloom_words, knows
from sparkdemand.llm.common import kept

#: (action, host, path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: Hosts that are blocked with their subdomains where no rule decides.
BLOCKED_HOSTS = ("cheap-pills.example.com", "spam-farm.example.org")
MAX_WORD_BYTES = 8 << 20
#: Share of other keys that a filter of ``BITS_PER_KEY`` lets through.
FALSE_SHARE = (1 - math.exp(-HASHES / BITS_PER_KEY)) ** HASHES
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Cascade:
    """The levels of one segment: arrays of 64-bit words, probed by two hashes of a key."""

    def __init__(self, levels: Sequence[np.ndarray]) -> None:
        self.levels = list(levels)

    @property
    def nbytes(self) -> int:
        return sum(w.nbytes for w in self.levels)

    def knows(self, level: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        return knows(self.levels[level], h1, h2, level)

    def listed(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        answer = np.zeros(len(h1), dtype=bool)
        left = np.arange(len(h1))
        for level in range(len(self.levels)):
            left = left[self.knows(level, h1[left], h2[left])]
            # Whoever passes an even level is listed, unless the next level takes it back.
            answer[left] = level % 2 == 0
        return answer


def _passing(keys: DataFrame, cascade: Cascade, level: int) -> DataFrame:
    sent = keys.sparkSession.sparkContext.broadcast(cascade)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sent.value.knows(level, batch.column(0).to_numpy(), batch.column(1).to_numpy())))

    return keys.mapInArrow(work, "h1 long, h2 long")


def hashed(keys: DataFrame) -> DataFrame:
    """``h1, h2`` of the column ``key``."""
    return keys.select(F.xxhash64("key").alias("h1"), F.xxhash64("key", F.lit(1)).alias("h2"))


def build_cascades(universe: DataFrame, listed: DataFrame, max_bytes: int = MAX_WORD_BYTES) -> Iterator[tuple[int, int, Cascade]]:
    """(segment, segments, cascade) over two kept tables ``h1, h2`` of distinct keys."""
    inside = listed.count()
    if inside == 0:
        return
    stored = inside + math.ceil(universe.count() * FALSE_SHARE)
    segments = max(1, -(-stored * BITS_PER_KEY // (4 * max_bytes)))  # the first two levels stay below half the bound
    for s in range(segments):
        part = F.pmod("h2", F.lit(segments)) == s
        sides = [listed.where(part), universe.where(part).join(listed, ["h1", "h2"], "left_anti")]
        cascade = Cascade([])
        level, n = 0, sides[0].count()
        while n:
            cascade.levels.append(bloom_words(sides[0], n, level, 8 * max_bytes))
            other = kept(_passing(sides[1], cascade, level))
            sides, level = [other, sides[0]], level + 1
            n = other.count()
        if cascade.nbytes > max_bytes:
            raise ValueError(f"a segment needs {cascade.nbytes} bytes; give a larger max_bytes")
        yield s, segments, cascade


def with_listed(rows: DataFrame, keys: str, universe: DataFrame, listed: DataFrame, name: str, max_bytes: int = MAX_WORD_BYTES) -> DataFrame:
    """Add ``name``: for each element of the array column ``keys``, whether it is listed."""
    rows = rows.withColumn(name, F.transform(keys, lambda _: F.lit(False)))
    h1 = F.transform(keys, lambda k: F.xxhash64(k))
    h2 = F.transform(keys, lambda k: F.xxhash64(k, F.lit(1)))
    for s, segments, cascade in build_cascades(universe, listed, max_bytes):
        if s:
            rows = kept(rows)
        sent = rows.sparkSession.sparkContext.broadcast(cascade)

        @F.pandas_udf("array<boolean>")
        def probe(a, b, sent=sent, s=s, segments=segments):
            sizes = [len(x) for x in a]
            if not sum(sizes):
                return a.map(lambda _: [])
            x, y = np.concatenate(a.to_numpy()).astype(np.int64), np.concatenate(b.to_numpy()).astype(np.int64)
            found = sent.value.listed(x, y) & (y % segments == s)
            return a.__class__(np.split(found, np.cumsum(sizes)[:-1]))

        rows = rows.withColumn(name, F.zip_with(name, probe(h1, h2), lambda x, y: x | y))
    return rows


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def _domains(host: Column) -> Column:
    """The host and its parent domains, longest first."""
    labels = F.split(host, r"\.")
    parents = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(parents)


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    blocked_hosts: Sequence[str] | DataFrame = BLOCKED_HOSTS,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every page.

    ``blocked_hosts`` is a list, or a table with the column ``key`` of any size.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), F.explode(F.array(F.struct(host.alias("host"), path.alias("path")))).alias("u"))
    rows = rows.select("page_id", "u.host", "u.path").withColumn("hosts", _domains(F.col("host")))
    sizes = sorted({len(p) for _, _, p in rules}, reverse=True)
    with_path = F.flatten(
        F.transform(
            "hosts",
            lambda h: F.filter(
                F.array(*[F.when(F.length("path") >= n, F.concat(h, F.substr("path", F.lit(1), F.lit(n)))) for n in sizes] or [F.lit(None).cast("string")]),
                lambda k: k.isNotNull(),
            ),
        )
    )
    # Longest first; the sort is stable in the order of the hosts because longer hosts come first in the array.
    keys = F.array_sort(
        F.transform(with_path, lambda k, i: F.struct((-F.length(k)).alias("n"), i.alias("i"), k.alias("k")))
    )
    rows = rows.withColumn("keys", F.transform(keys, lambda k: k["k"]))

    def all_keys(column: str) -> DataFrame:
        return kept(hashed(rows.select(F.explode(column).alias("key")).distinct()))

    def listing(keys: Sequence[str] | DataFrame) -> DataFrame:
        if not isinstance(keys, DataFrame):
            keys = spark.createDataFrame([(k,) for k in keys], "key string")
        return kept(hashed(keys.select("key").distinct()))

    universe = all_keys("keys")
    for action in ("block", "allow"):
        rows = with_listed(rows, "keys", universe, listing([h + p for a, h, p in rules if a == action]), action)
    rows = with_listed(rows, "hosts", all_keys("hosts"), listing(blocked_hosts), "listed_hosts")
    hits = F.zip_with("keys", F.arrays_zip("block", "allow"), lambda k, x: F.struct(k.alias("key"), x["block"].alias("block"), x["allow"].alias("allow")))
    hit = F.get(F.filter(hits, lambda x: x["block"] | x["allow"]), F.lit(0))
    rows = rows.select("page_id", "host", "path", hit.alias("hit"), F.exists("listed_hosts", lambda x: x).alias("listed"))
    verdict = F.when(F.col("hit").isNotNull(), F.when(F.col("hit.block"), "block").otherwise("allow")).otherwise(
        F.when(F.col("listed"), "block").otherwise("allow")
    )
    return rows.select("page_id", "host", "path", F.col("hit.key").alias("rule"), verdict.alias("verdict"))


#: The same in SQL: every key of the lists is compared.
FILTER_SQL = r"""
WITH u AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), r AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM u
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN host IN ('cheap-pills.example.com', 'spam-farm.example.org')
      OR host LIKE '%.cheap-pills.example.com' OR host LIKE '%.spam-farm.example.org' THEN 'block'
    ELSE 'allow' END AS verdict
FROM r
"""
