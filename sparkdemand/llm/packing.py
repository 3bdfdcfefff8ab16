"""Packing by powers of two: each document is split into pieces of binary lengths, equal lengths share a bucket.

A document of n tokens gives n div 4096 pieces of 4096 tokens and one piece for each binary digit of the rest, the
longest first.  Every piece is a sequence of its own, so no sequence crosses documents and none needs padding.
Sequences are numbered through the buckets (longest first), inside a bucket in document order, by global prefix
sums of the number of pieces of each length.

Tokens come from the tokenizers library; its normalizer and pre-tokenizer never look across white space.  Texts of
ASCII and Latin letters are lower-cased and cut into pre-tokens here, and the library's model merges each distinct
pre-token once; other runs of characters go through the whole library.

Defined results: null and empty texts are the end token alone (one piece of length 1); repeated rows and equal ids
give pieces for each row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdemand.llm.common import Cache, add_missing, kept, slices, text_blocks, with_prefix_sums, worker_table
from sparkdemand.llm.token_counts import byte_symbols

LENGTH = 4096
END_ID = 2
#: Characters whose pre-tokens are held at once.
CHARACTERS = 1 << 18
#: Controls that str.split() takes for white space and the tokenizer does not.
_ODD = re.compile("[\x1c-\x1f]")
#: Printable ASCII and the letters of Latin-1 and Latin Extended-A but for the dotted capital I: normal form and lower case are plain.
_PLAIN_RUN = re.compile("[!-~À-ÖØ-öø-įı-ſ]+")
_PLAIN_TEXT = re.compile("[!-~À-ÖØ-öø-įı-ſ \\t-\\r]*")
#: Fixed value: the vocabulary's pre-tokenizer on such characters in lower case.
_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^ \\t-\\ra-z0-9ß-öø-ſ]+")
_PIECES = "starts array<bigint>, lengths array<bigint>, crcs array<bigint>"


def piece_lengths(n: int, length: int = LENGTH) -> list[int]:
    """Lengths of the pieces of n tokens, longest first; ``length`` is a power of two."""
    rest = n % length
    return [length] * (n // length) + [1 << b for b in range(length.bit_length() - 2, -1, -1) if rest >> b & 1]


class Encoder:
    """Texts to little-endian 32-bit ids."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        stand_in = byte_symbols()
        self.bytes = {i: stand_in[i] for i in range(256)}
        self.cache = Cache()

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _make(self, keys: list[str]) -> list[bytes]:
        """Ids of pre-tokens; of whole runs where the key begins with a line break."""
        merge, symbols = self.model.tokenize, self.bytes
        runs = [k[1:] for k in keys if k[0] == "\n"]
        whole = iter(self._library(runs)) if runs else iter(())
        made = []
        for k in keys:
            if k[0] == "\n":
                made.append(next(whole))
            else:
                word = k if k.isascii() else k.encode().decode("latin-1").translate(symbols)
                made.append(array("I", [t.id for t in merge(word)]).tobytes())
        return made

    def _keys(self, text: str) -> list[str] | None:
        """Pre-tokens of a text in order; None if the library has to see it as a whole."""
        if "<|" not in text and _PLAIN_TEXT.fullmatch(text):
            return _WORD.findall(text.lower())
        if _ODD.search(text):
            return None
        keys: list[str] = []
        for run in text.split():
            if _PLAIN_RUN.fullmatch(run) and not ("<|" in run and any(s in run for s in self.special)):
                keys += _WORD.findall(run.lower())
            else:
                keys.append("\n" + run)
        return keys

    def block(self, texts: list[str]) -> list[bytes]:
        split = [self._keys(t) for t in texts]
        add_missing(self.cache, set().union(*(s for s in split if s)), self._make)
        get = self.cache.__getitem__
        return [self._library([t])[0] if s is None else b"".join(map(get, s)) for t, s in zip(texts, split, strict=True)]


@worker_table
def encoder_of(path: str) -> Encoder:
    """One encoder per worker process and vocabulary, so that later tasks find the words of earlier ones."""
    return Encoder(path)


def tokenize(docs: DataFrame, path: str, id_col: str, text_col: str, length: int, end_id: int, with_ids: bool) -> DataFrame:
    """One row per document: number of tokens, and start, length, checksum (and ids) of its pieces."""
    end = np.array([end_id], dtype="<u4").tobytes()
    names = ["doc_id", "doc_tokens", "tie", "starts", "lengths", "crcs", *["ids"] * with_ids]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in slices(batches):
            for start, block in text_blocks(batch.column(1).to_pylist(), CHARACTERS):
                counts, ties, sizes, starts, lengths, crcs, ids = [], [], [0], [], [], [], []
                for raw in encoder.block(block):
                    raw += end
                    view, at = memoryview(raw), 0
                    for own in piece_lengths(len(raw) // 4, length):
                        starts.append(at)
                        lengths.append(own)
                        crcs.append(zlib.crc32(view[4 * at : 4 * (at + own)]))
                        at += own
                    counts.append(at)
                    ties.append(zlib.crc32(view))
                    sizes.append(len(starts))
                    if with_ids:
                        ids.append(np.frombuffer(raw, dtype="<i4"))
                offsets = pa.array(sizes, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (starts, lengths, crcs)]
                arrays = [pa.array(counts, pa.int64()), pa.array(ties, pa.int64()), *lists]
                if with_ids:
                    cut = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
                    arrays.append(pa.ListArray.from_arrays(offsets, pa.ListArray.from_arrays(cut, pa.array(np.concatenate(ids)))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(block)), *arrays], names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, doc_tokens long, tie long, {_PIECES}" + ", ids array<array<int>>" * with_ids
    return rows.mapInArrow(work, schema)


def pack_documents(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, asked for, ``ids``."""
    top = length.bit_length() - 1
    tokens = kept(tokenize(docs, path, id_col, text_col, length, end_id, with_ids))
    # Pieces of each length, the longest first: n div length, then the binary digits of the rest.
    count = {f"p{top}": F.shiftright("doc_tokens", top)} | {
        f"p{b}": F.shiftright("doc_tokens", b).bitwiseAND(F.lit(1).cast("long")) for b in range(top - 1, -1, -1)
    }
    counts = tokens.select("doc_id", "tie", *[v.alias(k) for k, v in count.items()], *[c for c in tokens.columns if c not in ("doc_id", "tie")])
    placed = with_prefix_sums(counts, ["doc_id", "tie"], list(count))
    totals = counts.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(f"all_{k}") for k in count])
    bases, so_far = [], F.lit(0).cast("long")
    for k in count:
        bases.append(so_far)
        so_far = so_far + F.col(f"all_{k}")
    # One row with a number per bucket.
    first = totals.select(F.array(*bases).alias("first"))
    names = ["starts", "lengths", "crcs", *["ids"] * with_ids]
    pieces = placed.crossJoin(F.broadcast(first)).select(
        "doc_id",
        "doc_tokens",
        "first",
        F.array(*[F.col(f"before_{k}") for k in count]).alias("before"),
        F.posexplode(F.arrays_zip(*names)).alias("nth", "piece"),
    )
    bucket = F.lit(top) - F.log2(F.col("piece.lengths")).cast("int")
    nth = F.when(F.col("piece.lengths") == length, F.col("nth")).otherwise(0)
    return pieces.withColumn("bucket", bucket).select(
        "doc_id",
        F.col("piece.starts").alias("start"),
        F.col("piece.lengths").alias("length"),
        F.col("piece.crcs").alias("ids_crc32"),
        "doc_tokens",
        (F.get("first", F.col("bucket")) + F.get("before", F.col("bucket")) + nth).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        *[F.col("piece.ids").alias("ids")] * with_ids,
    )
