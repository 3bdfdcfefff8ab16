"""Alignment of two tokenizers' tokens by the byte offsets where both end, and corpus-wide counts of linked ids.

Everything inside a task is columns.  Texts of a block are cut where neither tokenizer joins anything (before a single
space between other characters, see ``_CUT``), the libraries' models encode each distinct unit (A: each distinct pre-token),
and Arrow lists of ids are taken per unit and flattened:

1. The parent indices of the flattened lists give each token its document; cumulative sums of byte lengths, less what stood
   before the document, give its end.
2. An Acero hash join of both token tables on (document, end) finds the offsets where tokens of both sides end; cumulative sums
   of these flags number the groups.
3. ``Table.group_by`` reduces each side to (group, id, occurrences), a join on the group pairs the ids, and two more
   reductions give the links of each (document, pair) and the documents of each pair in the block.  A group with many tokens costs
   its distinct pairs, not its occurrences.
4. Spark adds up the partial counts of all blocks, finds each A id's highest count, sends every block the counts of its own
   pairs, and the links of the block's documents are weighed with them.

Between the two passes a document is one row with its pairs as places in its block's list of pairs (compressed), so no
token is shuffled.  A pair's rows are one for each block that holds it, whatever its frequency.

Defined results: texts that are null or empty, or that the tokens do not give back byte by byte, have no tokens: zeros and an
empty digest; repeated rows and equal ids are documents of their own, each counted; an empty table gives no rows;
other columns are not read.  A block is at most ``BLOCK`` characters or one text, and must fit in a task.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdemand.llm.common import Cache, add_missing, kept, text_blocks
from sparkdemand.llm.token_counts import byte_symbols, pre_tokens

#: Characters of texts that are aligned together.
BLOCK = 1 << 21
#: Pre-tokens of A and units of B whose ids a task remembers.
KNOWN = 250_000
_PLAIN = re.compile(r" (?:\s|\Z)")
_CUT = re.compile(r"(?<! )(?= \S)")
_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


class Pair:
    """Two vocabularies: their libraries, and the bytes of every id."""

    def __init__(self, path_a: str, path_b: str) -> None:
        # One task, one core: the library would start threads of its own.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        own = {c: i for i, c in enumerate(byte_symbols())}
        raw_a = {i: bytes(own[c] for c in token) for token, i in vocab.items() if all(c in own for c in token)}
        self.bytes_a = [raw_a.get(i, b"") for i in range(self.a.get_vocab_size())]
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in side], dtype=np.int64) for side in (self.bytes_a, self.bytes_b))
        self.raw_a, self.raw_b = (pa.array(side, pa.large_binary()) for side in (self.bytes_a, self.bytes_b))
        # A group reads a1,a2|b1,b2 and groups are joined by semicolons: ids with the mark that follows them.
        self.marked_a = [pa.array([f"{i}{mark}" for i in range(len(self.bytes_a))]) for mark in ",|"]
        self.marked_b = [pa.array([f"{i}{mark}" for i in range(len(self.bytes_b))]) for mark in (",", ";", "")]
        stand_in = byte_symbols()
        self.symbols = {i: stand_in[i] for i in range(256)}
        self.known_words, self.known = Cache(), Cache()

    def _merged(self, words: list[str]) -> list[bytes]:
        """Ids of pre-tokens of A."""
        merge, symbols = self.a.model.tokenize, self.symbols
        return [array("i", [t.id for t in merge(w.encode().decode("latin-1").translate(symbols))]).tobytes() for w in words]

    def _made(self, units: list[str]) -> list[tuple[bytes, bytes]]:
        words = [pre_tokens(" " + u) for u in units]
        add_missing(self.known_words, set().union(*words), self._merged, KNOWN)
        get = self.known_words.__getitem__
        pieces = self.b.encode(units, num_threads=1)
        return [(b"".join(map(get, w)), array("i", ids).tobytes()) for w, ids in zip(words, pieces, strict=True)]

    def encode(self, units: list[str]) -> tuple[pa.ListArray, pa.ListArray]:
        """Ids of both sides of units, which are given without the space that each begins with."""
        add_missing(self.known, units, self._made, KNOWN)
        if not units:
            return _lists([]), _lists([])
        side_a, side_b = zip(*map(self.known.__getitem__, units), strict=True)
        return _lists(side_a), _lists(side_b)

    def lost(self, units: pa.Array, ids_a: pa.ListArray, ids_b: pa.ListArray) -> np.ndarray:
        """Which units one side does not give back."""
        spaced = pc.binary_join_element_wise(pa.scalar(""), units, " ")
        total = pc.sum(pc.binary_length(spaced)).as_py() or 0
        want = spaced.buffers()[2].slice(0, total).to_pybytes() if total else b""
        size = np.array(pc.add(pc.binary_length(units), 1), dtype=np.int64)
        bad = np.zeros(len(units), dtype=bool)
        for ids, raw in ((ids_a, self.raw_a), (ids_b, self.raw_b)):
            taken = raw.take(ids.flatten())
            ends = np.frombuffer(taken.buffers()[1], dtype=np.int64)[: len(taken) + 1]
            made = taken.buffers()[2].slice(0, int(ends[-1])).to_pybytes() if len(taken) else b""
            at = ends[np.asarray(ids.offsets)]
            if made == want and (np.diff(at) == size).all():
                continue
            own = np.cumsum(size) - size
            bad |= [made[s:e] != want[o : o + n] for s, e, o, n in zip(at[:-1], at[1:], own, size, strict=True)]
        return bad


def _lists(ids: Sequence[bytes]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64) // 4]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), dtype=np.int32)))


def units_of(text: str) -> list[str]:
    """The units of a text, each without the space that it begins with (the first one's stands before the text)."""
    if not text:
        return []
    if _PLAIN.search(" " + text) is None:
        return text.split(" ")
    return [u[1:] for u in _CUT.split(" " + text) if u]


@lru_cache(maxsize=1)
def pair_of(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def _flat(lists: pa.ListArray, unit: np.ndarray, owner: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, documents and ends (in their document) of all tokens of one side."""
    taken = lists.take(pa.array(unit))
    ids = taken.flatten().to_numpy()
    doc = owner[pc.list_parent_indices(taken).to_numpy()]
    run = np.cumsum(sizes[ids])
    before = np.concatenate([[0], run])[np.searchsorted(doc, np.arange(n))]
    return ids, doc, run - before[doc]


def _alone(group: np.ndarray) -> np.ndarray:
    """Which tokens are their group's only one; ``group`` ascends."""
    if not len(group):
        return np.empty(0, dtype=bool)
    new = np.r_[True, group[1:] != group[:-1]]
    return new & np.r_[new[1:], True]


def _counted(group: np.ndarray, ids: np.ndarray, name: str, times: str) -> pa.Table:
    """Distinct ids of each group and how often they stand in it: ``g, <name>, <times>``; ``group`` ascends."""
    alone = _alone(group)
    key = group << 32 | ids.astype(np.int64)
    keys = pa.table({"key": key[~alone]}).group_by("key", use_threads=False).aggregate([([], "count_all")])
    key = np.concatenate([key[alone], keys["key"].to_numpy()])
    count = np.concatenate([np.ones(int(alone.sum()), dtype=np.int64), keys["count_all"].to_numpy()])
    return pa.table({"g": key >> 32, name: key & 0xFFFFFFFF, times: count})


def _only(group: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """The id of each group's only token; -1 where it has none or several."""
    only = np.full(n, -1, dtype=np.int64)
    alone = _alone(group)
    only[group[alone]] = ids[alone]
    return only


def _paired(group_a: np.ndarray, id_a: np.ndarray, group_b: np.ndarray, id_b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Group, ids and occurrences of all distinct pairs: ``g, a, b, n``."""
    n = int(max([-1, *group_a[-1:], *group_b[-1:]])) + 1
    only_a, only_b = _only(group_a, id_a, n), _only(group_b, id_b, n)
    side_a, side_b = _counted(group_a, id_a, "a", "k"), _counted(group_b, id_b, "b", "l")
    (ga, a, k), (gb, b, l) = ([c.to_numpy() for c in side.columns] for side in (side_a, side_b))  # noqa: E741
    # Where one side is a single token its id stands beside the other side's; only the rest is joined.
    with_a = only_a[gb] >= 0
    with_b = (only_b[ga] >= 0) & (only_a[ga] < 0)
    left, right = only_b[ga] < 0, only_a[gb] < 0
    left &= only_a[ga] < 0
    right &= only_b[gb] < 0
    rest = side_a.filter(pa.array(left)).join(side_b.filter(pa.array(right)), "g", join_type="inner", use_threads=False)
    columns = (
        (gb[with_a], ga[with_b], rest["g"].to_numpy()),
        (only_a[gb[with_a]], a[with_b], rest["a"].to_numpy()),
        (b[with_a], only_b[ga[with_b]], rest["b"].to_numpy()),
        (l[with_a], k[with_b], pc.multiply(rest["k"], rest["l"]).to_numpy()),
    )
    return tuple(np.concatenate(c) for c in columns)


def _unlike(pair: Pair, text: str, units: list[int], sides: tuple[pa.ListArray, pa.ListArray]) -> bool:
    """Whether the joined bytes of one side differ from the text of some units that are not given back."""
    raw = (" " + text).encode()
    return any(b"".join([names[i] for u in units for i in side[u].as_py()]) != raw for side, names in zip(sides, (pair.bytes_a, pair.bytes_b), strict=True))


def align_block(pair: Pair, texts: list[str]) -> tuple[dict[str, np.ndarray | list], pa.Table, pa.Table]:
    """Counts and digest of each text; links (doc, pair, n), ordered by doc and pair; pairs (a, b, docs) of the block."""
    n = len(texts)
    cut = [units_of(t) for t in texts]
    flat = pa.array([u for units in cut for u in units], pa.string()).dictionary_encode()
    owner = np.repeat(np.arange(n), [len(units) for units in cut])
    unit = flat.indices.to_numpy()
    sides = pair.encode(flat.dictionary.to_pylist())
    bad = pair.lost(flat.dictionary, *sides)
    if bad.any():
        lost = np.zeros(n, dtype=bool)
        for i in np.unique(owner[bad[unit]]):
            lost[i] = _unlike(pair, texts[i], unit[owner == i].tolist(), sides)
        stay = ~lost[owner]
        unit, owner = unit[stay], owner[stay]
    id_a, doc_a, end_a = _flat(sides[0], unit, owner, pair.sizes_a, n)
    id_b, doc_b, end_b = _flat(sides[1], unit, owner, pair.sizes_b, n)
    # The offsets where both sides end; a key is a document and an end in one number.
    side_a = pa.table({"key": doc_a << 32 | end_a, "i": np.arange(len(id_a))})
    side_b = pa.table({"key": doc_b << 32 | end_b, "j": np.arange(len(id_b))})
    both = side_a.join(side_b, "key", join_type="inner", use_threads=False)
    last_a, last_b = np.zeros(len(id_a), dtype=bool), np.zeros(len(id_b), dtype=bool)
    last_a[both["i"].to_numpy()] = True
    last_b[both["j"].to_numpy()] = True
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    doc_of = doc_a[last_a]
    # Ids of each group with their occurrences, then the pairs.
    g, a, b, times = _paired(group_a, id_a, group_b, id_b)
    named = pa.array(a << 32 | b).dictionary_encode()
    linked = pa.table({"key": doc_of[g] << 32 | named.indices.to_numpy(), "n": times})
    links = linked.group_by("key", use_threads=False).aggregate([("n", "sum")]).sort_by("key")
    key = links["key"].to_numpy()
    links = pa.table({"doc": key >> 32, "pair": key & 0xFFFFFFFF, "n": links["n_sum"]})
    names = named.dictionary.to_numpy()
    docs = np.bincount(links["pair"].to_numpy(), minlength=len(names))
    pairs = pa.table({"a": names >> 32, "b": names & 0xFFFFFFFF, "docs": docs})
    counts = {
        "n_a": np.bincount(doc_a, minlength=n),
        "n_b": np.bincount(doc_b, minlength=n),
        "n_groups": np.bincount(doc_of, minlength=n),
        "n_links": _sums(links["doc"].to_numpy(), links["n"].to_numpy(), n),
        "groups_sha256": _digests(pair, id_a, doc_a, last_a, group_a, id_b, doc_b, last_b, n),
    }
    return counts, links, pairs


def _sums(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    edge = np.searchsorted(doc, np.arange(n + 1))
    return total[edge[1:]] - total[edge[:-1]]


def _digests(pair: Pair, id_a, doc_a, last_a, group_a, id_b, doc_b, last_b, n: int) -> list[str]:
    """SHA-256 of the written groups of each text, empty without tokens."""
    # A's tokens of a group come before B's: where each token stands in the order of writing.
    b_before = np.searchsorted(np.cumsum(last_b) - last_b, np.arange(len(doc_a[last_a]) + 1))
    a_through = np.searchsorted(group_a, np.arange(1, len(doc_a[last_a]) + 1))
    at_a = np.arange(len(id_a)) + b_before[group_a]
    at_b = np.arange(len(id_b)) + a_through[np.cumsum(last_b) - last_b]
    end_of_doc = np.r_[doc_b[1:] != doc_b[:-1], True] if len(doc_b) else np.empty(0, dtype=bool)
    texts = pa.concat_arrays([*pair.marked_a, *pair.marked_b])
    size_a, size_b = len(pair.bytes_a), len(pair.bytes_b)
    code = np.empty(len(id_a) + len(id_b), dtype=np.int64)
    code[at_a] = id_a + size_a * last_a
    code[at_b] = 2 * size_a + id_b + size_b * (last_b.astype(np.int64) + end_of_doc)
    written = texts.cast(pa.large_string()).take(pa.array(code))
    offsets = np.frombuffer(written.buffers()[1], dtype=np.int64)[: len(code) + 1]
    raw = memoryview(written.buffers()[2] or b"")
    edge = np.searchsorted(doc_a, np.arange(n + 1)) + np.searchsorted(doc_b, np.arange(n + 1))
    return [hashlib.sha256(raw[offsets[s] : offsets[e]]).hexdigest() if e > s else "" for s, e in zip(edge[:-1], edge[1:], strict=True)]


def _pressed(doc: np.ndarray, place: np.ndarray, times: np.ndarray, n: int) -> list[bytes]:
    """Each document's places (as steps) and occurrences, compressed."""
    edge = np.searchsorted(doc, np.arange(n + 1)).tolist()
    out = []
    for s, e in zip(edge[:-1], edge[1:], strict=True):
        both = np.concatenate([np.diff(place[s:e], prepend=0), times[s:e]]).astype("<i8")
        # Byte planes: the high bytes of small numbers are runs of zeros.
        out.append(pa.compress(both.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True) if e > s else b"")
    return out


def _opened(pressed: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(pa.decompress(pressed, 16 * n, codec="zstd", asbytes=True), dtype=np.uint8).reshape(8, -1)
    both = np.ascontiguousarray(both.T).view("<i8").ravel()
    return np.cumsum(both[:n]), both[n:]


def _aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows of documents, and after those of each block one row with its pairs (``pair_a`` not null)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    longs = pa.list_(pa.int32())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(path_a, path_b)
        block_no = TaskContext.get().partitionId() << 33
        for batch in batches:
            for start, texts in text_blocks(batch.column(1).to_pylist(), BLOCK):
                counts, links, pairs = align_block(pair, texts)
                n = len(texts)
                doc, place, times = (links[c].to_numpy() for c in ("doc", "pair", "n"))
                edge = np.searchsorted(doc, np.arange(n + 1))
                ids = pa.concat_arrays([batch.column(0).slice(start, n), pa.nulls(1, batch.column(0).type)])
                own = [pa.array([*x, None], t) for x, t in [*[(counts[c].tolist(), pa.int64()) for c in _COUNTS], (counts["groups_sha256"], pa.string())]]
                sizes = pa.array([*np.diff(edge).tolist(), None], pa.int64())
                pressed = pa.array([*_pressed(doc, place, times, n), None], pa.binary())
                listed = [pa.array([None] * n + [pairs[c].to_numpy()], longs) for c in ("a", "b", "docs")]
                numbers = pa.array(np.full(n + 1, block_no))
                names = ["block", "doc_id", *_COUNTS, "groups_sha256", "size", "links", "pair_a", "pair_b", "pair_docs"]
                yield pa.RecordBatch.from_arrays([numbers, ids, *own, sizes, pressed, *listed], names)
                block_no += 1

    counts = ", ".join(f"{c} long" for c in _COUNTS)
    schema = f"block long, doc_id {kind}, {counts}, groups_sha256 string, size long, links binary"
    return docs.mapInArrow(work, f"{schema}, pair_a array<int>, pair_b array<int>, pair_docs array<int>")


def _pair_counts(listed: DataFrame) -> DataFrame:
    """``a, b, count, best``: the documents that hold a pair, and whether no other pair of ``a`` is in more."""
    counts = listed.groupBy("a", "b").agg(F.sum("docs").alias("count"))
    # One row for each id of A: bounded by the vocabulary.
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(F.broadcast(most), "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents with their numbers and digest, and the table of pairs ``a, b, count, best``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    aligned = kept(_aligned(rows, path_a, path_b))
    zipped = F.arrays_zip(F.col("pair_a").alias("a"), F.col("pair_b").alias("b"), F.col("pair_docs").alias("docs"))
    listed = aligned.where("pair_a IS NOT NULL").select("block", F.posexplode(zipped).alias("pair", "p"))
    listed = listed.select("block", "pair", "p.a", "p.b", "p.docs")
    counts = kept(_pair_counts(listed))
    weights = listed.join(counts, ["a", "b"]).select(F.col("block").alias("of"), "pair", "count", "best")
    names = ["doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256"]

    def weigh(own: pa.Table, pairs: pa.Table) -> pa.Table:
        count = np.zeros(pairs.num_rows, dtype=np.int64)
        best = np.zeros(pairs.num_rows, dtype=np.int64)
        place = pairs["pair"].to_numpy()
        count[place] = pairs["count"].to_numpy()
        best[place] = pairs["best"].to_numpy(zero_copy_only=False)
        n_best, total = [], []
        for size, pressed in zip(own["size"].to_pylist(), own["links"].to_pylist(), strict=True):
            place, times = _opened(pressed, size) if size else (np.empty(0, np.int64), np.empty(0, np.int64))
            n_best.append(int((times * best[place]).sum()))
            total.append(int((times * count[place]).sum()))
        columns = [own[c] for c in ("doc_id", *_COUNTS)] + [pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), own["groups_sha256"]]
        return pa.table(columns, names=names)

    # A block's documents and pairs are bounded by the block.
    numbered = aligned.where("pair_a IS NULL").drop("pair_a", "pair_b", "pair_docs")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in names[1:-1]) + ", groups_sha256 string"
    return numbered.groupBy("block").cogroup(weights.groupBy("of")).applyInArrow(weigh, schema), counts


def align_digest(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    return align(docs, path_a, path_b, id_col, text_col)[0]
