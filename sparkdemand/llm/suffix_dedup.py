"""Repeated byte strings, found with longest-previous-factor arrays over sorted suffixes.

A string of ``LENGTH`` bytes that occurs twice need not be looked for among all suffixes of the corpus at once:

1. Each start of such a string is given an anchor, the 64-byte gram with the least hash inside the string.  Equal
   strings have equal anchors at equal places, so only suffixes with the same anchor gram can match.  Neighbouring
   starts share an anchor; a run of them and the bytes they see are one row (about one for 170 bytes).
2. Grams that occur once are dropped.  Runs with equal bytes are counted together, so thousands of copies are one
   row.  Only grams with several different runs need sorting.
3. For those the bytes are laid end to end and their suffixes sorted by rank doubling; common prefixes of
   neighbours, then previous and next smaller positions in suffix order, give for each start the longest factor that
   occurs earlier (and, by the same walk in reverse order, later).
4. Starts with a match of ``LENGTH`` bytes are carried back to all rows of the run and cut out of the texts.

A gram with more than ``MOST_RUNS`` different runs (a short passage that very many texts share) is not brought into
one task: its strings are counted by a 128-bit hash instead, which is spread over the cluster.

Order of occurrences: by doc_id (nulls first), a hash of the text, place.  With ``keep_first`` the first occurrence
stays and later ones go (the default); without it all occurrences go.

Defined results: null and empty texts, and texts below ``LENGTH`` bytes, lose nothing; equal texts are copies of
each other wherever they stand, repeated rows too, and with ``keep_first`` rows equal in doc_id and text are one
document that is not its own copy unless another document holds it; an empty table gives no rows; other columns of
the input pass through ``cut_repeats`` and are not read elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdemand.llm.bloom import bloom_words, knows, may_be_in, sent_words
from sparkdemand.llm.common import kept, slices

LENGTH = 400
GRAM = 64
MOST_RUNS = 4096
#: Bytes handled at once inside a task; longer texts are handled in overlapping pieces.  Each byte takes some hundred
#: bytes of arrays; blocks that fit the processor's cache also take half the time.
BLOCK = 1 << 16
_PLACE = (1 << 24) - 1
_FACTOR = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_RUNS = "a long, lo long, hi long, g long, x long"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte; powers of an odd factor and of its inverse."""
    n = 2 * BLOCK + 2 * LENGTH
    values = np.random.default_rng(11).integers(0, 1 << 64, 256, dtype=np.uint64)
    tables = []
    for factor in (_FACTOR, pow(_FACTOR, -1, 1 << 64)):
        out = np.full(n, factor, dtype=np.uint64)
        out[0] = 1
        tables.append(np.multiply.accumulate(out))
    return values, *tables


def find_runs(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Runs of starts with a common anchor: text number, anchor, first and last start, gram hash, hash of the bytes.

    Places count in the text.  All texts together have at most 2 * BLOCK bytes.
    """
    values, power, inverse = _tables()
    gram = min(GRAM, length // 4)
    b = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    if len(b) < length:
        return tuple(np.empty(0, np.int64) for _ in range(6))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[b] * power[: len(b)])])
    grams = _mix((sums[gram:] - sums[:-gram]) * inverse[: len(b) - gram + 1])
    # The place in the low bits makes the leftmost of equal grams the least.
    least = grams & np.uint64(~_PLACE & 0xFFFFFFFFFFFFFFFF) | np.arange(len(grams), dtype=np.uint64)
    window, span = length - gram + 1, 1
    while 2 * span <= window:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < window:
        least = np.minimum(least[: len(least) - (window - span)], least[window - span :])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    owner = np.repeat(np.arange(len(texts)), np.maximum(sizes - length + 1, 0))
    first = np.concatenate([np.arange(s, max(s, e - length + 1)) for s, e in zip(starts, ends, strict=True)])
    anchor = (least[first] & np.uint64(_PLACE)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(first) else np.empty(0, np.int64)
    last = np.r_[new[1:], len(first)] - 1 if len(first) else new
    lo, hi, a, owner = first[new], first[last], anchor[new], owner[new]
    seen = _mix((sums[hi + length] - sums[lo]) * inverse[lo])
    x = _mix(seen ^ _mix(((hi - lo) * 512 + (a - lo)).astype(np.uint64) + np.uint64(1)))
    at = starts[owner]
    return owner, a - at, lo - at, hi - at, grams[a].view(np.int64), x.view(np.int64)


def _pieces(text: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    """A text in pieces of at most BLOCK starts, each start in one piece with all its bytes."""
    for at in range(0, max(1, len(text) - length + 1), BLOCK):
        yield at, text[at : at + BLOCK + length - 1]


def gram_filter(grams: DataFrame) -> np.ndarray:
    """Bloom filter words of the column ``g``; the second hash is the first one turned by half its bits."""
    turned = F.shiftleft("g", 32).bitwiseOR(F.shiftrightunsigned("g", 32))
    return bloom_words(grams.select(F.col("g").alias("h1"), turned.alias("h2")), grams.count())


def runs_of(docs: DataFrame, length: int, columns: str, grams: np.ndarray | None = None) -> DataFrame:
    """One row per run of every text; ``docs`` has the columns of ``columns`` and the binary ``text`` last.

    With the filter words ``grams`` only runs whose gram may be among those.
    """
    names = [c.split()[0] for c in columns.split(", ")]
    sent = None if grams is None else docs.sparkSession.sparkContext.broadcast(grams)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            found = find_runs([p for _, _, p in block], length)
            if sent is not None:
                g = found[4].view(np.uint64)
                passing = knows(sent.value, g, g << np.uint64(32) | g >> np.uint64(32))
                found = tuple(c[passing] for c in found)
            owner, a, lo, hi, g, x = found
            row = np.array([r for r, _, _ in block], dtype=np.int64)[owner]
            at = np.array([s for _, s, _ in block], dtype=np.int64)[owner]
            own = [batch.column(i).take(pa.array(row)) for i in range(len(names))]
            return pa.RecordBatch.from_arrays([*own, *map(pa.array, (a + at, lo + at, hi + at, g, x))], [*names, "a", "lo", "hi", "g", "x"])

        for batch in batches:
            block, size = [], 0
            for row, text in enumerate(batch.column(len(names))):
                for at, piece in _pieces(text.as_py() or b"", length):
                    if len(piece) < length:
                        continue
                    if size + len(piece) > BLOCK and block:
                        yield flush()
                        block, size = [], 0
                    block.append((row, at, piece))
                    size += len(piece)
            if block:
                yield flush()

    return docs.select(*names, "text").mapInArrow(work, f"{columns}, {_RUNS}")


# --- suffix order inside a group of runs ------------------------------------------------------


def _dense(values: np.ndarray) -> np.ndarray:
    """Ranks of the values, equal ones alike; ``values`` is used up."""
    order = np.argsort(values)
    values[:] = values[order]
    new = np.zeros(len(values), dtype=np.int32)
    np.cumsum(values[1:] != values[:-1], dtype=np.int32, out=new[1:])
    rank = np.empty_like(new)
    rank[order] = new
    return rank


def _ranks(b: np.ndarray, length: int) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
    """Ranks of the substrings of 8, 16, ... bytes at all places, and of ``length`` bytes."""
    padded = np.concatenate([b, np.zeros(2 * length, np.uint8)])
    packed = np.zeros(len(b) + length, dtype=np.uint64)
    for k in range(8):
        packed = packed << np.uint64(8) | padded[k : k + len(packed)].astype(np.uint64)
    rank = _dense(packed)
    levels, size = [(8, rank)], 8

    def joined(step: int) -> np.ndarray:
        pair = rank.astype(np.int64)
        pair *= int(rank.max()) + 1
        pair[:-step] += rank[step:]
        return _dense(pair)

    while 2 * size <= length:
        rank = joined(size)
        size *= 2
        levels.append((size, rank))
    return levels, (joined(length - size) if size < length else rank)


def _common(levels: list[tuple[int, np.ndarray]], i: np.ndarray, j: np.ndarray, length: int) -> np.ndarray:
    """Common prefix of the suffixes at i and j, in steps of 8 bytes, ``length`` at most."""
    common = np.zeros(len(i), dtype=np.int64)
    for size, rank in reversed(levels):
        for _ in range(2):  # the largest size may fit twice before the rest
            same = (common + size <= length) & (rank[np.minimum(i + common, len(rank) - 1)] == rank[np.minimum(j + common, len(rank) - 1)])
            common += np.where(same, size, 0)
    return common


def _toward_smaller(position: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each suffix in order: common prefix with the nearest one before it that has a smaller position.

    ``common[i]`` belongs to the suffixes i - 1 and i.  All pointers jump at once: whoever points at a larger
    position takes over that one's pointer, with the shorter of both prefixes.
    """
    n = len(position)
    to = np.arange(n) - 1
    shared = common.copy()
    active = np.arange(n)[1:]
    active = active[position[to[active]] > position[active]]
    while len(active):
        over = to[active]
        shared[active] = np.minimum(shared[active], shared[over])
        to[active] = to[over]
        active = active[to[active] >= 0]
        active = active[position[to[active]] > position[active]]
    return np.where(to >= 0, shared, 0)


def longest_factors(b: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For each start: length of the longest factor that also starts earlier, and later, ``length`` at most.

    Lengths are in steps of 8 bytes; ``starts`` ascends and each has ``length`` bytes after it.
    """
    levels, rank = _ranks(b, length)
    order = np.argsort(rank[starts], kind="stable")
    position = starts[order]
    common = np.zeros(len(order), dtype=np.int64)
    common[1:] = _common(levels, position[:-1], position[1:], length)
    back = np.zeros(len(order), dtype=np.int64)
    back[1:] = common[:0:-1]

    def factors(place: np.ndarray) -> np.ndarray:
        before = _toward_smaller(place, common)
        after = _toward_smaller(place[::-1], back)[::-1]
        found = np.empty(len(order), dtype=np.int64)
        found[order] = np.maximum(before, after)
        return found

    return factors(position), factors(-position)


def _ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of true values."""
    edge = np.diff(np.r_[False, flags, False].astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def compare_runs(runs: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """``g, x, spans``: the starts (first and last, counted from ``lo``) of each run that have a match.

    ``runs``: g, x, ord (position of the run's first occurrence), bytes; a gram's rows come to one task.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: list[tuple]) -> pa.RecordBatch:
            # Rows that the fetch doubled are one; within a gram runs lie in the order of their occurrence.
            rows = sorted({r[:2]: r for r in rows}.values(), key=lambda r: (r[0], _order(r[2])))
            sizes = np.array([len(r[3]) for r in rows])
            at = np.cumsum(sizes) - sizes
            counts = sizes - length + 1
            starts = np.concatenate([np.arange(a, a + n) for a, n in zip(at, counts, strict=True)])
            earlier, later = longest_factors(np.frombuffer(b"".join(r[3] for r in rows), np.uint8), starts, length)
            hit = earlier >= length if keep_first else np.maximum(earlier, later) >= length
            spans = []
            for part in np.split(hit, np.cumsum(counts)[:-1]):
                first, last = _ranges(part)
                spans.append([{"first": int(f), "last": int(e)} for f, e in zip(first, last, strict=True)])
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(spans, kind)], ["g", "x", "spans"]
            )

        held: list[tuple] = []
        size = 0
        for batch in slices(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and size > BLOCK and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield solve(held)

    dealt = runs.select("g", "x", "ord", "bytes").repartition("g").sortWithinPartitions("g")
    return dealt.mapInArrow(work, "g long, x long, spans array<struct<first:long,last:long>>")


def _order(ord_: dict) -> tuple:
    return (ord_["id"] is not None, ord_["id"] if ord_["id"] is not None else 0, ord_["t"], ord_["a"])


def count_strings(runs: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """As ``compare_runs``, for grams with very many runs: every string is counted by a 128-bit hash of its bytes."""

    def strings() -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.length("bytes") - length),
            lambda i: F.struct(i.cast("long").alias("i"), F.substring("bytes", i + 1, F.lit(length)).alias("s")),
        )

    rows = runs.dropDuplicates(["g", "x"]).select("g", "x", "ord", F.inline(strings()))
    rows = kept(rows.select("g", "x", "ord", "i", F.xxhash64("s").alias("h1"), F.xxhash64(F.lit(1), "s").alias("h2")))
    place = F.struct("ord", "i")
    found = rows.groupBy("h1", "h2").agg(F.min(place).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    hit = rows.join(found, ["h1", "h2"]).where(place != F.col("least")) if keep_first else rows.join(found, ["h1", "h2"])
    one = F.struct(F.col("i").alias("first"), F.col("i").alias("last"))
    return hit.groupBy("g", "x").agg(F.collect_list(one).alias("spans"))  # at most one for each start of the run


# --- the whole job ------------------------------------------------------------------------------


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    # The id in a struct, so that null ids are equal in joins.
    return docs.select(F.struct(F.col(id_col).alias("id")).alias("d"), F.xxhash64(text).alias("t"), text.cast("binary").alias("text"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep_first: bool = True) -> DataFrame:
    """``d (id), t, spans``: for every text with repeats the byte ranges (from, to excluded) that go.

    With ``keep_first`` there is a row for each (id, text); without it one for each text (``d`` is null).
    """
    keyed = _keyed(docs, id_col, text_col).where(F.octet_length("text") >= length)
    columns = f"d {keyed.schema['d'].dataType.simpleString()}, t long"
    runs = runs_of(keyed, length, columns)
    repeated = kept(runs.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g"))
    same = ["t", "a", "lo", "hi", "g", "x"] if not keep_first else ["d", "t", "a", "lo", "hi", "g", "x"]
    place = F.struct(F.col("d.id").alias("id"), "t", "a")
    # Runs that may have a repeated gram stay, without a shuffle on the gram (a single gram passed by mistake finds
    # no partner later).  Equal texts give equal rows, which are counted together.
    runs = runs_of(keyed, length, columns, gram_filter(repeated))
    found = kept(runs.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("ord")))
    groups = kept(found.groupBy("g", "x").agg(F.sum("n").alias("m"), F.min(F.struct("ord", "lo", "hi")).alias("f")))
    mixed = groups.groupBy("g").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    wanted = groups.join(mixed, "g").select("g", "x", "kinds", "f.ord", "f.lo", "f.hi")
    # A text's runs are bounded by its length.
    row = F.struct("g", "x", "kinds", "ord", "lo", "hi")
    wanted = wanted.select(F.struct(F.col("ord.id").alias("id")).alias("d"), F.col("ord.t").alias("t"), row.alias("r"))
    wanted = kept(wanted.groupBy("d", "t").agg(F.collect_list("r").alias("rs"), F.max("r.kinds").alias("most")))

    def fetch(wanted: DataFrame) -> DataFrame:
        # Only texts that may be wanted are shuffled.
        rows = keyed.where(may_be_in("t", wanted)).join(wanted, ["d", "t"]).select("text", F.explode("rs").alias("r"))
        seen = F.substring("text", F.col("r.lo").cast("int") + 1, (F.col("r.hi") - F.col("r.lo")).cast("int") + length)
        return rows.select("r.g", "r.x", "r.kinds", "r.ord", seen.alias("bytes"))

    spans = compare_runs(fetch(wanted).where(F.col("kinds") <= MOST_RUNS), length, keep_first)
    hot = wanted.where(F.col("most") > MOST_RUNS)
    if not hot.isEmpty():
        spans = spans.union(count_strings(fetch(hot).where(F.col("kinds") > MOST_RUNS), length, keep_first))
    spans = kept(spans.where(F.size("spans") > 0))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("first"), (F.col("hi") - F.col("lo")).alias("last")))
    judged = found.join(groups.select("g", "x", "m", F.col("f.ord").alias("least")), ["g", "x"]).join(spans, ["g", "x"], "left")
    # A run that is copied as a whole goes as a whole (but for its first place); else the starts that have a match.
    copied = (F.col("ord") != F.col("least")) if keep_first else F.col("m") > 1
    judged = judged.withColumn("spans", F.when(copied, whole).otherwise(F.col("spans"))).where("spans IS NOT NULL")
    ranges = judged.select(
        (F.col("d") if keep_first else F.lit(None).cast(keyed.schema["d"].dataType)).alias("d"),
        "t",
        F.inline(F.transform("spans", lambda s: F.struct((F.col("lo") + s["first"]).alias("from"), (F.col("lo") + s["last"] + length).alias("to")))),
    )
    return ranges.groupBy("d", "t").agg(F.collect_list(F.struct("from", "to")).alias("spans"))


def cut(text: bytes, spans: list[dict] | None) -> tuple[bytes, int, int]:
    """The text without its spans, the bytes removed and the number of maximal removed runs."""
    out, done, runs = [], 0, 0
    start = 0
    for first, last in sorted((s["from"], s["to"]) for s in spans or ()):
        if not runs or first > done:
            out.append(text[start:first] if runs else text[:first])
            runs += 1
        done = max(done, last)
        start = done
    rest = b"".join([*out, text[start:] if runs else text])
    return rest, len(text) - len(rest), runs


def repeat_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept, kept_text`` when all occurrences of repeated strings go.

    ``kept_text`` is what is left as text; bytes of a letter cut in half are not in it, but in the hash and in ``n_kept``.
    """
    spans = kept(repeated_spans(docs, id_col, text_col, length, keep_first=False).select("t", "spans"))
    texts = _keyed(docs, id_col, text_col).select(F.col("d.id").alias("doc_id"), "t", "text")
    words = sent_words("t", spans)
    # The join always shuffles, so a task never runs the filter's Python worker and the digest's at once.
    hit = texts.where(may_be_in("t", spans, words)).join(spans.hint("merge"), "t", "left").select("doc_id", "text", "spans")
    # Texts that can't have spans stay where they are; the filter is asked beside the digest.
    rest = texts.select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"), "t", F.xxhash64("t").alias("h"))

    def without_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            near = knows(words.value, batch.column(3).to_numpy(), batch.column(4).to_numpy())
            yield from work([batch.filter(pa.array(~near))])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[tuple] = []
            for text, own in zip(batch.column(1), batch.column(2), strict=True):
                raw = text.as_py()
                left, removed, runs = cut(raw, own.as_py())
                out.append((len(raw), removed, runs, hashlib.sha256(left).hexdigest(), len(left), left.decode("utf-8", "ignore")))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [*[pa.int64()] * 3, pa.string(), pa.int64(), pa.string()]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_kept", "kept_text"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_kept long, kept_text string"
    return hit.mapInArrow(work, schema).union(rest.mapInArrow(without_hits, schema))


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """All columns of ``docs`` with later copies cut out of the text; bytes of a letter cut in half are dropped."""
    spans = kept(repeated_spans(docs, id_col, text_col, length, keep_first=True).withColumnsRenamed({"d": "d__", "t": "t__", "spans": "spans__"}))
    near = may_be_in("t__", spans)
    rows = docs.withColumns({"k__": F.struct(F.col(id_col).alias("id")), "t__": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    own = spans.withColumnRenamed("t__", "h__")
    # The join always shuffles, so a task never runs the filter's Python worker and the cutting one at once.
    hit = rows.where(near).join(own.hint("merge"), (F.col("k__") == F.col("d__")) & (F.col("t__") == F.col("h__")), "left")

    @F.pandas_udf("string")
    def without(texts, spans):
        return texts.__class__([cut(t.encode(), list(s))[0].decode("utf-8", "ignore") for t, s in zip(texts, spans, strict=True)])

    kind = spans.schema["spans__"].dataType
    rest = without(F.coalesce(F.col(text_col), F.lit("")), F.coalesce("spans__", F.array().cast(kind)))
    changed = hit.withColumn(text_col, F.when(F.col("spans__").isNull(), F.col(text_col)).otherwise(rest))
    # Texts that can't have spans stay where they are.
    return changed.select(*docs.columns).union(rows.where(~near).select(*docs.columns))
