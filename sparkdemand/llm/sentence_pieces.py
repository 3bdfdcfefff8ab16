"""Encoding and decoding with a SentencePiece BPE model through tables of prefixes.

A text is cut where a space follows something else (no piece of such a model holds a space after another letter,
so merges never cross).  For each distinct word a table keeps, for every prefix, the one last token that its
encoding ends with: of the vocabulary pieces that an automaton finds to end there, it is the one that the last
token of the prefix before it can stand next to.  Ids are recovered backwards through the table.

Two tokens can stand next to each other if merging their joined text gives them back.  Merges are local: as long as
no merge has crossed a border, both sides behave as they do alone, so testing each border by itself is exact.

Defined results: null and empty texts have no ids, so both hashes are those of the empty string; characters that the
vocabulary lacks become their UTF-8 byte pieces; repeated rows give repeated rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from sparkdemand.llm.common import LONGEST, Cache, add_missing, text_blocks

SPACE = "▁"
_NORMAL, _BYTE, _USER = 1, 6, 4
_NEVER = float("-inf")
_PLAIN = re.compile(f"{SPACE}{SPACE}|{SPACE}\\Z")
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*")


class PieceModel:
    """The vocabulary of a model file, its automaton, and the memo of tested borders."""

    def __init__(self, path: str) -> None:
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        pieces = [(p.piece, i) for i, p in enumerate(model.pieces) if p.type == _NORMAL]
        if (
            model.trainer_spec.model_type != 2
            or not model.trainer_spec.byte_fallback
            or norm.precompiled_charsmap
            or norm.remove_extra_whitespaces
            or not (norm.add_dummy_prefix and norm.escape_whitespaces)
            or any(p.type == _USER for p in model.pieces)
            or any(SPACE in p.lstrip(SPACE) for p, _ in pieces)
        ):
            raise ValueError("only BPE models with byte fallback, kept white space and words led by spaces are handled")
        self.ids = dict(pieces)
        self.score = {p: model.pieces[i].score for p, i in pieces}
        self.text = {i: p for p, i in pieces}
        self.size = {i: len(p) for p, i in pieces}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == _BYTE}
        self.values = {i: b for b, i in self.byte.items()}
        self.inside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.borders: dict[int, bool] = {}
        self.histories: dict[str, tuple[list[float], list[str], list[str], bool]] = {}
        self.found: dict[str, list[int]] = {}
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            if self._history(p)[3]:  # pieces that no merging makes can't appear
                self.automaton.add_word(p, self.ids[p])
        self.automaton.make_automaton()

    def _history(self, piece: str) -> tuple[list[float], list[str], list[str], bool]:
        """Merging of one piece alone, best score first, then leftmost.

        Scores in the order of the merges, then the first and the last part before each merge and after all, and
        whether the piece comes out whole.
        """
        known = self.histories.get(piece)
        if known is not None:
            return known
        parts, score = list(piece), self.score
        scores, first, last = [], [parts[0]], [parts[-1]]
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            scores.append(best)
            first.append(parts[0])
            last.append(parts[-1])
        known = self.histories[piece] = ([*scores, _NEVER], first, last, len(parts) == 1)
        return known

    def _fit(self, left: str, right: str) -> bool:
        a_scores, _, a_last, _ = self._history(left)
        b_scores, b_first, _, _ = self._history(right)
        i = j = 0
        while True:
            a, b = a_scores[i], b_scores[j]
            across = self.score.get(a_last[i] + b_first[j])
            if across is not None and across > a and across >= b:
                return False
            if a == b == _NEVER:
                return True
            if a >= b:
                i += 1
            else:
                j += 1

    def segments(self, word: str) -> list[str]:
        """The word cut between letters that no piece holds side by side: nothing merges across."""
        cut, start, inside = [], 0, self.inside
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in inside:
                cut.append(word[start:i])
                start = i
        cut.append(word[start:])
        return cut

    def encode_segment(self, text: str) -> list[int]:
        """Ids of a segment: the last token of every prefix, then backwards through these."""
        last = [-1] * len(text)
        borders, size = self.borders, self.size
        for end, i in self.automaton.iter(text):
            if last[end] >= 0:
                continue
            start = end - size[i]
            if start < 0:
                last[end] = i
                continue
            before = last[start]
            if before < 0:  # an unknown character, which merges with nothing
                last[end] = i
                continue
            key = before << 32 | i
            fits = borders.get(key)
            if fits is None:
                if len(borders) > 1_000_000:
                    borders.clear()
                fits = borders[key] = self._fit(self.text[before], self.text[i])
            if fits:
                last[end] = i
        ids: list[int] = []
        end = len(text) - 1
        while end >= 0:
            i = last[end]
            if i < 0:
                ids += [self.byte[b] for b in reversed(text[end].encode("utf-8", "replace"))]
                end -= 1
            else:
                ids.append(i)
                end -= size[i]
        ids.reverse()
        return ids

    def word_ids(self, word: str) -> list[int]:
        found = self.found
        if len(found) > 400_000:  # of at most ``LONGEST`` characters each
            found.clear()
        ids: list[int] = []
        for part in self.segments(word):
            own = found.get(part)
            if own is None:
                own = self.encode_segment(part)
                if len(part) <= LONGEST:
                    found[part] = own
            ids += own
        return ids

    def decode(self, ids: list[int]) -> str:
        """Text of ids, the first space left out; runs of byte pieces are read as UTF-8."""
        if self.values.keys().isdisjoint(ids):
            return "".join([self.text.get(i, "") for i in ids]).replace(SPACE, " ").removeprefix(" ")
        out: list[str] = []
        run = bytearray()
        for i in [*ids, None]:
            if i in self.values:
                run.append(self.values[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            if i is not None:
                out.append(self.text.get(i, "").replace(SPACE, " "))
        return "".join(out).removeprefix(" ")


def words_of(text: str) -> list[str]:
    """Words of a text, each with the spaces before it."""
    if not text:
        return []
    text = SPACE + text.replace(" ", SPACE)
    if _PLAIN.search(text) is None:
        return text[1:].split(SPACE)
    return [w[1:] for w in _WORD.findall(text)]


class Codec:
    """Encodes and decodes texts as concatenations of words, each distinct word once."""

    def __init__(self, path: str) -> None:
        self.model = PieceModel(path)
        self.cache = Cache()

    def _make(self, words: list[str]) -> list[tuple[int, str, str]]:
        made = []
        for word in words:
            ids = self.model.word_ids(SPACE + word)
            # Led by an id that is no space, so that the word keeps its own.
            made.append((len(ids), ",".join(map(str, ids)), " " + self.model.decode(ids)))
        return made

    def block(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """(number of ids, ids joined by commas, decoded text) of each text."""
        split = [words_of(t) for t in texts]
        add_missing(self.cache, set().union(*split), self._make, 700_000)
        get = self.cache.__getitem__
        for words in split:
            if words:
                counts, ids, decoded = zip(*map(get, words), strict=True)
                yield sum(counts), ",".join(ids), "".join(decoded)[1:]
            else:
                yield 0, "", ""


@lru_cache(maxsize=2)
def codec_of(path: str) -> Codec:
    """One codec per worker process and model, so that later tasks find the words of earlier ones."""
    return Codec(path)


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, decoded``: the ids of every text and the text that they decode to."""
    return _run(docs, path, id_col, text_col, "ids array<int>, decoded string", lambda n, ids, text: ([int(i) for i in ids.split(",") if i], text))


def encode_digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``."""

    def digest(n: int, ids: str, text: str) -> tuple[int, str, str]:
        return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()

    return _run(docs, path, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", digest)


def _run(docs: DataFrame, path: str, id_col: str, text_col: str, columns: str, result) -> DataFrame:
    names = [c.split()[0] for c in columns.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for batch in batches:
            for start, block in text_blocks(batch.column(1).to_pylist()):
                rows = list(zip(*(result(*r) for r in codec.block(block)), strict=True))
                arrays = [pa.array(c, pa.list_(pa.int32()) if names[i] == "ids" else None) for i, c in enumerate(rows)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(block)), *arrays], ["doc_id", *names])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {columns}")
