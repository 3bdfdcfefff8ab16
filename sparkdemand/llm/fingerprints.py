"""Document fingerprints by one-permutation MinHash with optimal densification and b-bit values.

The hash of every shingle (five words) is computed once; its leading bits name a bin and each bin keeps its least
hash.  An empty bin takes the value of a full one, chosen by probing the bins in a random order of its own until one
is full, so every full bin is equally likely and two texts choose alike.  The fingerprint is the low eight bits of
the 128 values in hex.  Two fingerprints agree in a bin by chance once in 256 times; the likeness is corrected for
that.  Everything is DataFrame functions.

Defined results: null and empty texts, and texts without words, have the empty fingerprint; two empty fingerprints
have likeness 1, an empty and another one 0; the document after the last is the first, in the order of doc_id (nulls
first), then of a hash of the text, so a repeated row follows its copy; an empty table gives no rows; other columns
of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkdemand.llm.common import shuffle_width
from sparkdemand.llm.words import let, shingle_hashes, words_of

SHINGLE = 5
BIN_BITS = 7
BINS = 1 << BIN_BITS
VALUE_BITS = 8
#: Keys sampled for each range when documents are dealt in order.
SAMPLED = 8


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BIN_BITS).cast("int")


def _densified(least: Column) -> Column:
    """Values of all bins from the least hashes of the full ones."""

    def fill(full: Column) -> Column:
        def value(j: Column) -> Column:
            own = F.array_position(full, j)
            # The first full bin in this bin's probing order is the one with the least hash of (bin, full bin).
            donor = F.array_min(F.transform(full, lambda b, i: F.struct(F.xxhash64(j, b).alias("o"), (i + 1).alias("i"))))
            return F.element_at(least, F.when(own > 0, own.cast("int")).otherwise(donor["i"]))

        return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), value)

    return let(F.transform(least, _bin), fill)


def fingerprint(text: Column) -> Column:
    """Hex string of 2 * BINS digits; empty for a text without words."""

    def firsts(h: Column) -> Column:
        return F.filter(h, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(h, i - 1))))

    def packed(values: Column) -> Column:
        low = F.transform(values, lambda v: F.lpad(F.hex(v.bitwiseAND(F.lit((1 << VALUE_BITS) - 1))), 2, "0"))
        return F.array_join(low, "")

    def from_hashes(h: Column) -> Column:
        return F.when(F.size(h) == 0, "").otherwise(let(let(h, firsts), lambda least: packed(_densified(least))))

    return let(words_of(text), lambda w: from_hashes(F.sort_array(shingle_hashes(w, SHINGLE))))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles of two fingerprints, corrected for chance agreement."""
    chance = 1.0 / (1 << VALUE_BITS)
    places = F.sequence(F.lit(1), F.lit(2 * BINS - 1), F.lit(2))
    same = F.size(F.filter(places, lambda i: F.substr(a, i, F.lit(2)) == F.substr(b, i, F.lit(2))))
    share = F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(share)


def with_next(docs: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Add ``next_<column>``: the value of the next row by ``id_col``, after the last that of the first.

    Rows are dealt into ranges whose bounds are keys of existing rows (a bounded sample, 8 per range, and the first
    key).  The row at a bound goes to its own range and, as its end, to the range before, so each range finds the
    next row of all its rows by itself.
    """
    spark = docs.sparkSession
    keyed = docs.withColumn("key__", F.struct(F.col(id_col).alias("id"), F.xxhash64(columns[0]).alias("tie")))
    n = docs.count()
    least = keyed.agg(F.min("key__").alias("key__")).first()[0]
    wanted = 4 * shuffle_width(docs)
    found = keyed.select("key__").sample(min(1.0, SAMPLED * wanted / max(n, 1)), seed=3).take(2 * SAMPLED * wanted)
    order = lambda k: (k["id"] is not None, k["id"] if k["id"] is not None else 0, k["tie"])
    keys = sorted({r[0] for r in found}, key=order)
    bounds = sorted({least, *keys[:: max(1, len(keys) // wanted)]} - {None}, key=order)
    kind = keyed.schema["key__"].dataType
    row = spark.createDataFrame([(bounds,)], f"bounds__ array<{kind.simpleString()}>")
    steps = F.array(*[F.lit(1 << b) for b in range(max(1, len(bounds)).bit_length(), -1, -1)])
    at = F.aggregate(
        steps, F.lit(-1), lambda a, s: F.when(F.get("bounds__", a + s) <= F.col("key__"), a + s).otherwise(a)
    )
    own = F.struct(F.col("at__").alias("range__"), F.lit(False).alias("end__"), F.lit(False).alias("wrap__"))
    before = F.struct(
        F.when(F.col("at__") == 0, len(bounds) - 1).otherwise(F.col("at__") - 1).alias("range__"),
        F.lit(True).alias("end__"),
        (F.col("at__") == 0).alias("wrap__"),
    )
    bound = F.get("bounds__", F.col("at__")) == F.col("key__")
    dealt = keyed.crossJoin(F.broadcast(row)).withColumn("at__", at)
    dealt = dealt.select(*docs.columns, "key__", F.inline(F.when(bound, F.array(own, before)).otherwise(F.array(own))))
    inside = Window.partitionBy("range__").orderBy("wrap__", "end__", "key__")
    return (
        dealt.withColumns({f"next_{c}": F.lead(c).over(inside) for c in columns})
        .where(~F.col("end__"))
        .drop("key__", "range__", "end__", "wrap__")
    )


def fingerprint_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("fingerprint", fingerprint(F.col("text")))
    paired = with_next(rows, "doc_id", ["text", "fingerprint"])
    n = F.length("text")
    edited = F.concat(
        F.substr("text", F.lit(1), n - F.floor(n / 2).cast("int")), F.substr("next_text", F.lit(1), F.floor(n / 2).cast("int"))
    )
    made = paired.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        "fingerprint",
        "next_fingerprint",
        F.explode(F.array(edited)).alias("edited"),
    )
    made = made.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "next_fingerprint",
        F.explode(F.array(fingerprint(F.col("edited")))).alias("edited_fingerprint"),
    )
    return made.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
