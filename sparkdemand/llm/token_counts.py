"""Token counts of a byte-level BPE vocabulary by rank-synchronous merging of ragged arrays.

Texts are cut where the vocabulary's pre-tokenizer always cuts (before a single space that is followed by other
than white space).  The distinct pieces that a task has not met yet are pre-tokenized, laid end to end in one numpy
array of symbols, and merged together: in each round every sequence applies its own lowest-rank pair at all its
places, left to right.  What survives is counted.  Texts are counted as sums over their pieces.

Defined results: null and empty texts have 0 bytes and 0 tokens; special strings inside a text count as one token,
as is the library's default; repeated rows give repeated rows; other columns of the input are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdemand.llm.common import Cache, add_missing, text_blocks

LIMIT = 512
#: Fixed value: the pattern of byte-level pre-tokenizers; white space is Unicode's White_Space.
_PRE = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?![^\p{White_Space}])|\p{White_Space}+"
)
#: The same for ASCII text.
_PRE_ASCII = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)
_PLAIN = re.compile(r" (?:\s|\Z)")
_CUT = re.compile(r"(?= \S)")
_FAR = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies: itself, or the next free one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of a text, as byte-level vocabularies cut it."""
    return (_PRE_ASCII if text.isascii() else _PRE).findall(text)


class Merger:
    """The merge table of a vocabulary file as sorted arrays."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.base = np.array([vocab[c] for c in byte_symbols()], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.arange(len(keys))[order]
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)  # by rank
        self.words = Cache()
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _FAR)

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols left of each piece after all merges."""
        lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        result = lengths.copy()
        owner = np.repeat(np.arange(len(pieces)), lengths)
        symbol = self.base[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        rank = np.full(len(symbol), _FAR)
        if len(symbol) > 1:
            rank[:-1] = np.where(owner[1:] == owner[:-1], self._rank(symbol[:-1], symbol[1:]), _FAR)
        while len(symbol):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(owner)])
            lowest = np.minimum.reduceat(rank, starts)
            going = lowest < _FAR
            result[owner[starts]] = sizes
            if not going.any():
                break
            if not going.all():  # finished sequences leave the arrays
                stay = np.repeat(going, sizes)
                owner, symbol, rank = owner[stay], symbol[stay], rank[stay]
                lowest, sizes = lowest[going], sizes[going]
            hit = rank == np.repeat(lowest, sizes)
            # Of overlapping places (a run of one symbol) every second is taken, from the left.
            at = np.flatnonzero(hit)
            run = np.r_[True, np.diff(at) > 1]
            first = at[np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))]
            at = at[(at - first) % 2 == 0]
            symbol[at] = self.made[rank[at]]
            keep = np.ones(len(symbol), dtype=bool)
            keep[at + 1] = False
            moved = np.cumsum(keep)[at] - 1
            owner, symbol, rank = owner[keep], symbol[keep], rank[keep]
            touched = np.zeros(len(symbol), dtype=bool)
            touched[moved] = True
            touched[np.maximum(moved - 1, 0)] = True
            rank[touched] = _FAR
            touched[-1] = False
            fresh = np.flatnonzero(touched)
            fresh = fresh[owner[fresh] == owner[fresh + 1]]
            rank[fresh] = self._rank(symbol[fresh], symbol[fresh + 1])
        return result

    def count_pieces(self, pieces: list[str]) -> list[int]:
        """Tokens of each piece: its pre-tokens are merged together with those of all other pieces."""
        found = [pre_tokens(p) for p in pieces]
        add_missing(self.words, set().union(*found), lambda new: self.count([w.encode("utf-8", "surrogatepass") for w in new]).tolist(), 700_000)
        get = self.words.__getitem__
        return [sum(map(get, ws)) for ws in found]


def cut_text(text: str) -> list[str]:
    """Pieces of a text, all but the first without the space before them."""
    if _PLAIN.search(text) is None:
        return text.split(" ")
    head, *rest = _CUT.split(text)
    return [head, *[r[1:] for r in rest]]


class Counter:
    def __init__(self, path: str) -> None:
        self.merger = Merger(path)
        self.heads = Cache()  # the first piece of a segment has no space before it
        self.tails = Cache()

    def block(self, texts: list[str]) -> list[int]:
        special = self.merger.special
        cut, extra = [], []
        for text in texts:
            parts = special.split(text) if special is not None and special.search(text) else [text]
            extra.append(len(parts) - 1)
            cut.append([cut_text(p) for p in parts])
        add_missing(self.heads, {p[0] for parts in cut for p in parts}, self.merger.count_pieces, 700_000)
        add_missing(self.tails, set().union(*(p[1:] for parts in cut for p in parts)), self._spaced, 700_000)
        head, tail = self.heads.__getitem__, self.tails.__getitem__
        return [n + sum(head(p[0]) + sum(map(tail, p[1:])) for p in parts) for n, parts in zip(extra, cut, strict=True)]

    def _spaced(self, pieces: list[str]) -> list[int]:
        return self.merger.count_pieces([" " + p for p in pieces])


@lru_cache(maxsize=2)
def counter_of(path: str) -> Counter:
    """One counter per worker process and vocabulary, so that later tasks find the pieces of earlier ones."""
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every document under the vocabulary file at ``path``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        for batch in batches:
            counts: list[int] = []
            for _, block in text_blocks(batch.column(1).to_pylist()):
                counts += counter.block(block)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    n_bytes = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), n_bytes)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long"
    return rows.mapInArrow(work, schema).withColumn("over_limit", F.col("n_tokens") > limit)
