"""Repeated runs of words, found by super-k-mers.

A window is ``WINDOW`` consecutive words of one document.  Its minimiser is the least hash among its grams of ``GRAM``
words.  Consecutive windows with an equal minimiser form a super-k-mer: their words travel as one packed string
to the bucket of the minimiser, about nine windows in 28 words.  Equal windows have equal minimisers, so all copies of
a window meet in one bucket, where the windows are sorted and equal neighbours compared as strings.

1. Minimisers are counted over the whole corpus, by place.  Where one has a single place no window repeats;
   a Bloom filter of the others spares most of them the way (it is bounded; beyond the bound more super-k-mers
   travel, at most all, which is three times the text, and the result is the same).
2. Buckets are dealt by minimiser.  A minimiser with more rows than a quarter of a mean partition (there are at
   most four per partition) is dealt into as many parts as it needs, by document.  Each part settles its
   own windows and sends on the first one of each kind; these meet by the window itself, one per part.
3. Spans of covered words go back to their documents and are cut out.

A window's first occurrence stays: smallest doc_id (nulls first), then a hash of the text, then place.

Defined results: null and empty texts and texts below ``WINDOW`` words lose nothing; rows equal in doc_id and text
are one document, which is no copy of itself, and have equal results; different texts under one id are different
documents; an empty table gives no rows; other columns pass through ``cut_repeated_words`` and are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkdemand.llm.bloom import bloom_words, knows, may_be_in
from sparkdemand.llm.common import kept, shuffle_width, text_blocks

WINDOW = 20
GRAM = 4
#: Words of a text that are handled together; longer texts are handled in overlapping pieces.
PIECE = 1 << 18
#: Largest filter of minimisers: 64 MB, ten bits for each of 53 million.
FILTER_BITS = 1 << 29
#: Bytes of packed strings that a bucket task sorts together, if its groups allow.
BLOCK = 1 << 22
_PLACE = np.uint64((1 << 24) - 1)
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8; white space is space and \\t to \\r."""
    return (text or "").encode("utf-8", "replace").split()


def super_kmers(texts: list[list[bytes]], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Text number, minimiser, first and last window of every super-k-mer, and the places where the minimiser stands.

    ``texts`` are lists of words, less than 2^24 in all.
    """
    sizes = np.array([len(w) for w in texts], dtype=np.int64)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for words in texts for w in words], dtype=np.uint64)
    if len(hashes) < window:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    n = len(hashes) - gram + 1
    grams = hashes[:n].copy()
    for k in range(1, gram):
        grams = _mix(grams + _M3) + hashes[k : n + k]
    grams = _mix(grams)
    # The place in the low bits makes the leftmost of equal grams the least.
    least, span, wide = grams & ~_PLACE | np.arange(n, dtype=np.uint64), 1, window - gram + 1
    while 2 * span <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < wide:
        least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    counts = np.maximum(sizes - window + 1, 0)
    owner = np.repeat(np.arange(len(texts)), counts)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    if not len(owner):
        return tuple(np.empty(0, np.int64) for _ in range(5))
    place = least[starts[owner] + inside] & _PLACE
    own = grams[place]
    new = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (owner[1:] != owner[:-1])])
    last = np.r_[new[1:], len(own)] - 1
    moves = np.cumsum(np.r_[0, place[1:] != place[:-1]])
    return owner[new], own[new].view(np.int64), inside[new], inside[last], moves[last] - moves[new] + 1


def _extract(docs: DataFrame, keys: str, window: int, gram: int, filter_words: np.ndarray | None, hot: dict[int, int] | None) -> DataFrame:
    """Minimisers and their places (m, w), and with a filter the whole super-k-mers: ``keys``, m, w, part, lo, packed.

    ``docs``: the columns of ``keys`` (the last one a hash of the text) and ``text`` last.  ``hot`` has the number of parts of
    minimisers that are dealt into several.
    """
    names = [c.split()[0] for c in keys.split(", ")]
    sent = None if filter_words is None else docs.sparkSession.sparkContext.broadcast((filter_words, *_sorted(hot)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(names)).to_pylist()
            spread = batch.column(len(names) - 1).to_numpy().view(np.uint64)
            for start, block in text_blocks(texts):
                pieces, row, at = [], [], []
                for i, text in enumerate(block):
                    words = words_of(text)
                    for lo in range(0, max(0, len(words) - window + 1), PIECE):
                        pieces.append(words[lo : lo + PIECE + window - 1])
                        row.append(start + i)
                        at.append(lo)
                owner, m, lo, hi, w = super_kmers(pieces, window, gram)
                if sent is None:
                    yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(w)], ["m", "w"])
                    continue
                bits, hot_m, hot_parts = sent.value
                passing = np.flatnonzero(knows(bits, m, _turned(m)))
                owner, m, lo, hi, w = (x[passing] for x in (owner, m, lo, hi, w))
                packed = [b" ".join(pieces[o][a : b + window]) for o, a, b in zip(owner.tolist(), lo.tolist(), hi.tolist(), strict=True)]
                rows = np.array(row, dtype=np.int64)[owner] if len(owner) else owner
                part = np.zeros(len(m), dtype=np.int64)
                if len(hot_m):
                    place = np.minimum(np.searchsorted(hot_m, m), len(hot_m) - 1)
                    own = hot_m[place] == m
                    part[own] = 1 + (spread[rows[own]] % hot_parts[place[own]]).astype(np.int64)
                lo = lo + np.array(at, dtype=np.int64)[owner] if len(owner) else lo
                keyed = [batch.column(i).take(pa.array(rows)) for i in range(len(names))]
                arrays = [*keyed, *map(pa.array, (m, w, part, lo)), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, [*names, "m", "w", "part", "lo", "packed"])

    schema = "m long, w long" if sent is None else f"{keys}, m long, w long, part long, lo long, packed binary"
    return docs.mapInArrow(work, schema)


def _sorted(hot: dict[int, int] | None) -> tuple[np.ndarray, np.ndarray]:
    keys = sorted(hot or {})
    return np.array(keys, dtype=np.int64), np.array([hot[k] for k in keys], dtype=np.uint64)


def _turned(m: np.ndarray) -> np.ndarray:
    """A second hash of a minimiser: the first one turned by half its bits."""
    u = m.view(np.uint64)
    return u << np.uint64(32) | u >> np.uint64(32)


def _windows(packed: bytes, window: int) -> list[bytes]:
    """All windows of a packed string."""
    spaces = np.flatnonzero(np.frombuffer(packed, dtype=np.uint8) == 32).tolist()
    starts, ends = [0, *[s + 1 for s in spaces]], [*spaces, len(packed)]
    return [packed[a:b] for a, b in zip(starts, ends[window - 1 :], strict=False)]


def _settle(rows: pa.Table, names: list[str], window: int) -> pa.RecordBatch:
    """Spans of later windows of whole buckets, and the first windows of buckets that are dealt into parts.

    ``rows`` are ordered by bucket, then by document and place.
    """
    lo, part = rows["lo"].to_numpy(), rows["part"].to_numpy()
    packed = rows["packed"].to_pylist()
    place = list(zip(*(rows[n].to_pylist() for n in names if n != "d"), [d["id"] for d in rows["d"].to_pylist()], lo.tolist(), strict=True))
    windows: list[bytes] = []
    row, nth = [], []
    out_row, out_from, out_to, out_window = [], [], [], []
    known: dict[bytes, int] = {}  # a packed string belongs to one minimiser, so to one bucket but for parts
    for r, (own, p) in enumerate(zip(packed, part.tolist(), strict=True)):
        first = known.get(own)
        if first is not None and part[first] == p:
            if place[first] != place[r]:  # a copy as a whole
                out_row.append(r)
                out_from.append(0)
                out_to.append(own.count(b" ") + 1)
                out_window.append(None)
            continue
        known[own] = r
        found = _windows(own, window)
        windows += found
        row += [r] * len(found)
        nth += range(len(found))
    order = sorted(range(len(windows)), key=windows.__getitem__)  # stable: equal windows stay in their order
    before, before_part = None, None
    later = np.zeros(len(windows), dtype=bool)
    firsts = []
    parts = part[row].tolist() if row else []
    # Parts of one minimiser may share a block: sorted by window, then by part, as rows come part by part.
    for k in order:
        if windows[k] == before and parts[k] == before_part:
            later[k] = True
        else:
            before, before_part = windows[k], parts[k]
            if before_part:
                firsts.append(k)
    rows_of, nths = np.array(row, dtype=np.int64), np.array(nth, dtype=np.int64)
    edge = np.flatnonzero(later)
    if len(edge):
        cut = np.r_[True, (np.diff(edge) > 1) | (np.diff(rows_of[edge]) != 0)]
        head = edge[cut]
        tail = edge[np.r_[np.flatnonzero(cut)[1:], len(edge)] - 1]
        out_row += rows_of[head].tolist()
        out_from += nths[head].tolist()
        out_to += (nths[tail] + window).tolist()
        out_window += [None] * len(head)
    out_row += [row[k] for k in firsts]
    out_from += [nth[k] for k in firsts]
    out_to += [nth[k] + window for k in firsts]
    out_window += [windows[k] for k in firsts]
    at = np.array(out_row, dtype=np.int64)
    base = lo[at] if len(at) else at
    keyed = [rows[n].combine_chunks().take(pa.array(at)) for n in names]
    spans = [pa.array(base + np.array(x, dtype=np.int64)) for x in (out_from, out_to)]
    return pa.RecordBatch.from_arrays([*keyed, *spans, pa.array(out_window, pa.binary())], [*names, "from", "to", "window"])


def _bucket_spans(travelled: DataFrame, keys: str, window: int) -> DataFrame:
    """Settle every bucket (minimiser and part): rows of spans, and of first windows where ``window`` is not null."""
    names = [c.split()[0] for c in keys.split(", ")]

    def whole(rows: pa.Table) -> pa.Table:
        """Rows whose bucket has others too, and those in which the minimiser stands at several places."""
        m, part = rows["m"].to_numpy(), rows["part"].to_numpy()
        same = np.r_[False, (m[1:] == m[:-1]) & (part[1:] == part[:-1]), False]
        # Parts of hot minimisers always send on their first windows.
        return rows.filter(pa.array(same[1:] | same[:-1] | (part > 0) | (rows["w"].to_numpy() > 1)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            if held.nbytes < BLOCK:
                continue
            m, part = held["m"].to_numpy(), held["part"].to_numpy()
            other = np.flatnonzero((m != m[-1]) | (part != part[-1]))
            if len(other):  # all but the last bucket, which may go on
                at = int(other[-1]) + 1
                if (ready := whole(held.slice(0, at))).num_rows:
                    yield _settle(ready, names, window)
                held = held.slice(at).combine_chunks()
        if held is not None and (ready := whole(held)).num_rows:
            yield _settle(ready, names, window)

    order = ["m", "part", *names, "lo"]
    dealt = travelled.repartition("m", "part").sortWithinPartitions(*order)
    return dealt.mapInArrow(work, f"{keys}, from long, to long, window binary")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    # The id in a struct, so that null ids are equal in joins and come first in orders.
    return docs.select(F.struct(F.col(id_col).alias("id")).alias("d"), F.xxhash64(F.lit(1), text).alias("t2"), F.xxhash64(text).alias("t"), text.alias("text"))


def repeated_word_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``d (id), t2, t, spans``: for every document with later copies the ranges of words (from, to excluded) that go."""
    keyed = _keyed(docs, id_col, text_col)
    keys = f"d {keyed.schema['d'].dataType.simpleString()}, t2 long, t long"
    found = _extract(keyed, keys, window, gram, None, None)
    counts = found.groupBy("m").agg(F.sum("w").alias("n"))
    repeated = kept(counts.where("n > 1"))
    total = repeated.agg(F.count(F.lit(1)).alias("kinds"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    most = max(1, total.n // (4 * shuffle_width(docs)))
    # Minimisers with more rows than ``most``: at most four for each partition of a shuffle.
    hot = {r.m: -(-r.n // most) for r in repeated.where(F.col("n") > most).collect()}
    turned = F.shiftleft("m", 32).bitwiseOR(F.shiftrightunsigned("m", 32))
    bits = bloom_words(repeated.select(F.col("m").alias("h1"), turned.alias("h2")), total.kinds, most_bits=FILTER_BITS)
    settled = kept(_bucket_spans(_extract(keyed, keys, window, gram, bits, hot), keys, window))
    spans = settled.where("window IS NULL").select("d", "t2", "t", "from", "to")
    # First windows of the parts of a hot minimiser: one for each part and window.
    places = Window.partitionBy("window").orderBy("d", "t2", "t", "from")
    beaten = settled.where("window IS NOT NULL").withColumn("nth", F.rank().over(places)).where("nth > 1")
    spans = spans.union(beaten.select("d", "t2", "t", "from", "to"))
    # A text's spans are bounded by its words.
    return spans.groupBy("d", "t2", "t").agg(F.collect_set(F.struct("from", "to")).alias("spans"))


def cut(words: list[bytes], spans: list[dict] | None) -> list[bytes]:
    """The words that no span covers."""
    out: list[bytes] = []
    at = 0
    for first, last in sorted((s["from"], s["to"]) for s in spans or ()):
        if first > at:
            out += words[at:first]
        at = max(at, last)
    return out + words[at:]


def _matched(docs: DataFrame, id_col: str, text_col: str, window: int, gram: int) -> DataFrame:
    """``docs`` with the column ``spans__``, null where nothing goes; texts that can't have spans stay where they are."""
    spans = kept(repeated_word_spans(docs, id_col, text_col, window, gram).withColumnsRenamed({"d": "d__", "t2": "t2__", "t": "t__", "spans": "spans__"}))
    text = F.coalesce(F.col(text_col), F.lit(""))
    near = may_be_in("t__", spans)
    rows = docs.withColumns({"d__": F.struct(F.col(id_col).alias("id")), "t2__": F.xxhash64(F.lit(1), text), "t__": F.xxhash64(text)})
    hit = rows.where(near).join(spans, ["d__", "t2__", "t__"], "left").select(*docs.columns, "spans__")
    return hit.union(rows.where(~near).select(*docs.columns, F.lit(None).cast(spans.schema["spans__"].dataType)))


def repeat_words_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, n_kept, kept_text``; the text is the kept words joined by one space."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = _matched(rows, "doc_id", "text", window, gram)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                words = words_of(text.as_py())
                rest = cut(words, spans.as_py())
                raw = b" ".join(rest)
                out.append((len(words), len(words) - len(rest), hashlib.sha256(raw).hexdigest(), len(rest), raw.decode()))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_words", "n_removed", "kept_sha256", "n_kept", "kept_text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, n_kept long, kept_text string")


def cut_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """All columns of ``docs``; texts that lose words are joined anew by single spaces, others stay as they are."""
    rows = _matched(docs, id_col, text_col, window, gram)

    @F.pandas_udf("string")
    def without(texts, spans):
        return texts.__class__([b" ".join(cut(words_of(t), list(s))).decode() for t, s in zip(texts, spans, strict=True)])

    kind = rows.schema["spans__"].dataType
    rest = without(F.coalesce(F.col(text_col), F.lit("")), F.coalesce("spans__", F.array().cast(kind)))
    return rows.withColumn(text_col, F.when(F.col("spans__").isNull(), F.col(text_col)).otherwise(rest)).select(*docs.columns)


#: The rows of the query in SQL: every window against all others.
REPEAT_WORDS_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS nth FROM windows) WHERE nth > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later
), placed AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w
), rest AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS s FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256,
  coalesce(n, 0)::BIGINT AS n_kept, coalesce(s, '') AS kept_text
FROM w LEFT JOIN rest USING (doc_id)
"""
