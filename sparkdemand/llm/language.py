"""Language identification in two steps: first the family, then the languages inside it.

Every text is a vector of hashed byte trigrams (lower case, everything in ASCII but letters read as spaces), as shares
of its trigrams.  Linear support vector machines, one for each pair of families and one for each pair of languages
inside a family, are fitted on a bounded sample of labelled texts; votes decide, then the sum of the distances.
Whole texts are scored: the weights of all their trigrams are averaged.

Bound of the sample: ``PER_LANGUAGE`` expected rows for each language, drawn at random; Spark tasks make the vectors
and fit the machines, one pair each.  Weights have a fixed size per pair.

Defined results: a text that is null or holds no letter is ``und`` with score 0; without any labelled text all are
``und``; with one language all texts with letters are in it with score 1; repeated rows are judged alike; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdemand.llm.common import SLICE, give_back, slices, text_blocks

PER_LANGUAGE = 600
BITS = 13
SIZE = 1 << BITS
#: Shares are small numbers; this brings them to the size of one.
SCALE = 30.0
COST = 10.0
#: Columns of the sample that are brought to double precision at once.
COLUMNS = 512
#: Characters whose trigrams are made at once.
CHARACTERS = 1 << 17
#: Language codes by family; other codes are families of their own.
FAMILIES = {
    "germanic": "af da de en is nl no sv",
    "romance": "ca es fr gl it pt ro",
    "slavic": "bg cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "finnic": "et fi",
    "turkic": "az tr",
    "indic": "bn gu hi mr ne pa ur",
    "dravidian": "kn ml ta te",
    "semitic": "ar he",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_TO_SPACE = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def family_of(lang: str) -> str:
    return _FAMILY.get(lang, lang)


def trigrams(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts end to end, and where each text starts; every text has one at least."""
    raw = [b" " + t.lower().encode("utf-8", "replace").translate(_TO_SPACE) + b" " for t in texts]
    raw = [r if len(r) > 2 else b"   " for r in raw]
    sizes = np.array([len(r) for r in raw])
    b = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint32)
    code = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761) >> np.uint32(32 - BITS)
    starts = np.cumsum(sizes) - sizes
    keep = np.ones(len(b), dtype=bool)
    keep[starts + sizes - 1] = keep[starts + sizes - 2] = False  # no trigram reaches over the end of its text
    return code[keep[:-2]], starts - 2 * np.arange(len(raw))


@dataclass
class Machines:
    """Pairs ((a, b), weights, bias): a positive distance speaks for a."""

    langs: list[str]
    pairs: list[tuple[str, str]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((SIZE, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def predict(self, texts: Sequence[str]) -> tuple[list[str], np.ndarray]:
        codes, starts = trigrams(texts)
        counts = np.diff(np.r_[starts, len(codes)])
        far = np.column_stack(
            [np.add.reduceat(self.weights[:, k][codes], starts) for k in range(len(self.pairs))] or [np.zeros((len(texts), 0))]
        )
        far = far * SCALE / counts[:, None] + self.bias
        families = sorted({family_of(x) for x in self.langs})
        family, sure = self._vote(families, far)
        lang, score = np.zeros(len(texts), dtype=object), sure.copy()
        for i, f in enumerate(families):
            own = [x for x in self.langs if family_of(x) == f]
            at = family == i
            winner, inner = self._vote(own, far[at])
            lang[at] = np.array(own, dtype=object)[winner]
            score[at] = np.minimum(score[at], inner)
        return lang.tolist(), score

    def _vote(self, names: list[str], far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Winner of the pairs among ``names``, and how sure its closest win is (0.5 to 1, or less if it lost one)."""
        votes, total = np.zeros((len(far), len(names))), np.zeros((len(far), len(names)))
        margin = np.full((len(far), len(names)), np.inf)
        for k, (a, b) in enumerate(self.pairs):
            if a in names and b in names:
                for name, d in ((a, far[:, k]), (b, -far[:, k])):
                    i = names.index(name)
                    votes[:, i] += d > 0
                    total[:, i] += d
                    margin[:, i] = np.minimum(margin[:, i], d)
        winner = np.argmax(votes + total / (1e3 + 2 * np.abs(total).sum(axis=1, keepdims=True)), axis=1)
        closest = np.clip(margin[np.arange(len(far)), winner], -30, 30)
        return winner, 1 / (1 + np.exp(-2 * closest))


def fit_pair(x: np.ndarray, y: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by dual coordinate descent on the inner products of a bounded sample.

    The last column of ``x`` is one, for the bias.  ``x`` is the largest thing here and is not copied.
    """
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    soft = 1 / (2 * COST * weight)
    inner = x @ x.T
    inner *= y[:, None]
    inner *= y
    diagonal = inner.diagonal() + soft
    alpha, gradient = np.zeros(len(y)), -np.ones(len(y))
    order = np.random.default_rng(0)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(y)):
            step = max(-alpha[i], -(gradient[i] + soft[i] * alpha[i]) / diagonal[i])
            if step:
                alpha[i] += step
                gradient += step * inner[:, i]
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    signed = alpha * y
    w = np.concatenate([signed @ x[:, k : k + COLUMNS] for k in range(0, x.shape[1], COLUMNS)])
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Machines:
    """Machines from the labelled rows of ``docs`` (others are ignored)."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    langs = sorted(counts)
    pairs = [(a, b) for i, a in enumerate(langs) for b in langs[i + 1 :] if family_of(a) == family_of(b)]
    families = sorted({family_of(x) for x in langs})
    pairs += [(a, b) for i, a in enumerate(families) for b in families[i + 1 :]]
    pairs = list(dict.fromkeys(pairs))
    machines = Machines(langs)
    if not pairs:
        return machines
    sample = rows.sampleBy("lang", {k: min(1.0, per_language / n) for k, n in counts.items()}, seed=5)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in slices(batches):
            langs_here = batch.column(1).to_pylist()
            for start, block in text_blocks(batch.column(0).to_pylist(), CHARACTERS):
                codes, starts = trigrams(block)
                out: dict[str, list] = {"pair": [], "y": [], "at": [], "share": []}
                for lang, own in zip(langs_here[start:], np.split(codes, starts[1:]), strict=False):
                    at, n = np.unique(own, return_counts=True)
                    share = (n * (SCALE / len(own))).astype(np.float32)
                    for k, (a, b) in enumerate(pairs):
                        side = 1 if a in (lang, family_of(lang)) else -1 if b in (lang, family_of(lang)) else 0
                        if side:
                            for name, v in zip(out, (k, side, at.astype(np.int32), share), strict=True):
                                out[name].append(v)
                types = (pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))

    def train(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((len(rows), SIZE + 1), np.float32)
        x[:, SIZE] = 1
        for i, (at, share) in enumerate(zip(rows["at"], rows["share"], strict=True)):
            x[i, at] = share
        w, b = fit_pair(x, rows["y"].to_numpy().astype(np.float32))
        return pd.DataFrame({"pair": [key[0]], "w": [w.astype(np.float32)], "b": [b]})

    fitted = (
        sample.mapInArrow(vectors, "pair int, y int, at array<int>, share array<float>")
        .groupBy("pair")  # a bounded number of rows each
        .applyInPandas(train, "pair int, w array<float>, b double")
        .orderBy("pair")
        .collect()
    )
    machines.pairs = [pairs[r["pair"]] for r in fitted]
    machines.weights = np.array([r["w"] for r in fitted], dtype=np.float32).T.copy(order="F")
    machines.bias = np.array([r["b"] for r in fitted], dtype=np.float32)
    return machines


def predict(
    docs: DataFrame, machines: Machines, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """All columns of ``docs`` plus the language and its score, under ``names``."""
    lang, score = names
    if not machines.langs:
        return docs.withColumns({lang: F.lit("und"), score: F.lit(0.0)})
    sent = docs.sparkSession.sparkContext.broadcast(machines)

    @F.arrow_udf("lang string, score double")
    def judge(texts: pa.Array) -> pa.Array:
        give_back()
        langs: list[str] = []
        scores: list[np.ndarray] = []
        for at in range(0, len(texts), SLICE):
            for _, block in text_blocks(texts.slice(at, SLICE).to_pylist(), CHARACTERS):
                found, sure = sent.value.predict(block)
                langs += found
                scores.append(sure)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate([*scores, np.zeros(0)]))], ["lang", "score"])

    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return (
        docs.withColumn("judged__", judge(F.col(text_col)))
        .withColumns(
            {
                lang: F.when(lettered, F.col("judged__.lang")).otherwise("und"),
                score: F.when(lettered, F.col("judged__.score")).otherwise(0.0),
            }
        )
        .drop("judged__")
    )


def held_out(id_col: str = "doc_id") -> Column:
    """Every fifth document by a checksum of its id; a null id is never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def language_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score``; learned from the documents that are not held out."""
    machines = fit(docs.where(~held_out(id_col)), text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return predict(rows, machines).select("doc_id", "held_out", "lang_pred", "score")
