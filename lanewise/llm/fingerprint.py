"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import adding, through_arrow, tidy
from .textnum import CHUNK_BYTES, Densifier, WordHasher, one_permutation, text_chunks

BIN_BITS = 9
LOW_BITS = 8
#: Ranges of doc_id for each partition.
RANGES_EACH = 4
_STEP = 64


def likeness(a: np.ndarray | None, b: np.ndarray | None, low_bits: int = LOW_BITS) -> float:
    """Estimated resemblance of two sketches: agreeing bins, less those expected to agree by chance on their low bits.
    Two texts without words are alike (1), one with and one without are not (0)."""
    if a is None or b is None:
        return float(a is None and b is None)
    chance = 2.0**-low_bits
    return min(1.0, max(0.0, (float(np.mean(a == b)) - chance) / (1 - chance)))


class Sketcher:
    """Texts to sketches: arrays of the low bits of each bin's minimum, or None for a text without words."""

    def __init__(self, bin_bits: int = BIN_BITS, low_bits: int = LOW_BITS):
        self.hasher, self.densifier = WordHasher(), Densifier(bin_bits)
        self.bin_bits, self.low_bits = bin_bits, low_bits

    def sketches(self, texts: pa.Array) -> list[np.ndarray | None]:
        out = []
        for _, _, data, starts in text_chunks(texts):
            for hashes in self.hasher.shingles(data, starts):
                if len(hashes):
                    full = self.densifier.fill(*one_permutation(np.sort(hashes), self.bin_bits))
                    # The minimum's low end is nearly uniform; its top bits name the bin.
                    out.append((full & np.uint64((1 << self.low_bits) - 1)).astype(np.uint8))
                else:
                    out.append(None)
        return out

    def pack(self, sketch: np.ndarray | None) -> str:
        """Hexadecimal digits of the packed low bits; empty for a text without words."""
        if sketch is None:
            return ""
        if self.low_bits == 8:
            return sketch.tobytes().hex()
        bits = np.unpackbits(sketch[:, None], axis=1)[:, 8 - self.low_bits :]
        return np.packbits(bits).tobytes().hex()


def fingerprints(docs: DataFrame, text: str = "text", bin_bits: int = BIN_BITS, low_bits: int = LOW_BITS) -> DataFrame:
    """All columns of docs and `fingerprint`.  A null text counts as empty; its fingerprint is empty."""
    docs, names, schema = adding(docs, fingerprint="string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(bin_bits, low_bits)
        for batch in batches:
            texts = batch.column(names.index(text)).fill_null("")
            prints = pa.array([sketcher.pack(s) for s in sketcher.sketches(texts)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, prints], [*names, "fingerprint"])

    return through_arrow(docs, run, schema)


def _split_points(keys: DataFrame, parts: int) -> list[int]:
    """The least key and the quantiles after it; at most `parts` numbers reach the driver."""
    row = keys.agg(
        F.min("key").alias("low"),
        F.percentile_approx("key", [k / parts for k in range(1, parts)] or [0.5], 10 * parts).alias("cuts"),
    ).first()
    cuts = [] if row.low is None else sorted({row.low, *(row.cuts or [])})
    if any(abs(c) >= 1 << 53 for c in cuts):
        # Quantiles of such keys are rounded: the least key from each on is taken, so that every range has a first row.
        at, _ = _place(F.col("key"), cuts)
        cuts = sorted(r.low for r in keys.groupBy(at.alias("at")).agg(F.min("key").alias("low")).collect())
    return cuts


def _place(key: Column, cuts: list[int]) -> tuple[Column, Column]:
    """(the last cut not above the key, as its number; that cut).  Two steps: every 64th cut, then the 64 from there."""
    array = lambda xs: F.from_json(F.lit(json.dumps(xs)), "array<bigint>")
    below = lambda xs: F.size(F.filter(xs, lambda c: c <= key))
    block = below(array(cuts[::_STEP])) - 1
    fine = F.slice(array(cuts), F.greatest(block, F.lit(0)) * _STEP + 1, F.lit(_STEP))
    at = F.greatest(block, F.lit(0)) * _STEP + below(fine) - 1
    return at, F.get(array(cuts), at)


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """docs dealt into ranges of ascending doc_id, each followed by a copy of the row that comes after it.

    One shuffle moves every row once; only the first row of each range is sent twice.  Rows with a null doc_id come last,
    in the order of their texts' hashes, in ranges of their own.  Returns (range, ahead, doc_id, text) sorted within
    partitions; ahead marks the copies.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.withColumn("key", F.coalesce("doc_id", F.xxhash64("text")))
    # More ranges than partitions even out what hashing gives to each.
    known = _split_points(docs.where("doc_id is not null").select(F.col("doc_id").alias("key")), RANGES_EACH * parts)
    lost = _split_points(keyed.where("doc_id is null").select("key"), RANGES_EACH * parts)
    no_id, key = F.col("doc_id").isNull(), F.col("key")
    (at, cut), (at_lost, cut_lost) = _place(key, known), _place(key, lost)
    placed = keyed.withColumn("own", F.when(no_id, len(known) + at_lost).otherwise(at) if lost else at)
    first = F.when(no_id, cut_lost).otherwise(cut) == key if lost else cut == key
    before = F.when(first, F.pmod(F.col("own") - 1, F.lit(max(1, len(known) + len(lost)))))
    dealt = placed.select(
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.col("own").alias("range"), F.lit(False).alias("ahead")),
                    F.struct(before.cast("int").alias("range"), F.lit(True).alias("ahead")),
                ),
                lambda x: x["range"].isNotNull(),
            )
        ).alias("to"),
        "doc_id",
        "text",
        "key",
    ).select("to.range", "to.ahead", "doc_id", "text", "key")
    ordered = dealt.repartition(parts, "range").sortWithinPartitions("range", "ahead", "key", F.hash("text"))
    return ordered.select("range", "ahead", "doc_id", "text")


RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def edited_fingerprints(docs: DataFrame, parts: int) -> DataFrame:
    """The fingerprint of every text and of its edited text, with their likeness and that to the next document.

    Rows with a null doc_id come after all others; a null text counts as empty; rows that share a doc_id follow one
    another.  A text without words has an empty fingerprint.  A single document is its own next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher()

        def followed() -> Iterator[list[tuple]]:
            held = None  # the last row, which waits for the one after it
            for batch in batches:
                # Small slices bound what is held beside the batch, whatever the texts' lengths.
                sizes, lo = np.cumsum(pc.binary_length(batch.column(3)).to_numpy(False), dtype=np.int64), 0
                while lo < batch.num_rows:
                    hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + 4 * CHUNK_BYTES, "right")))
                    part, pairs = batch.slice(lo, hi - lo), []
                    columns = [part.column(k).to_pylist() for k in range(4)]
                    for row in zip(*columns, sketcher.sketches(part.column(3)), strict=True):
                        if held is not None and held[0] == row[0] and not held[1]:
                            pairs.append((held[2:], row[3:]))
                        held = row
                    yield pairs
                    lo = hi

        for pairs in followed():
            edited = []
            for (_, text, _), (following, _) in pairs:
                n = len(text)
                edited.append(text[: n - n // 2] + following[: n // 2])
            sketches = sketcher.sketches(pa.array(edited, pa.large_string()))
            out = [
                (
                    i,
                    len(text),
                    hashlib.sha256(new.encode()).hexdigest(),
                    sketcher.pack(own),
                    sketcher.pack(changed),
                    likeness(own, changed),
                    likeness(own, after),
                )
                for ((i, text, own), (_, after)), new, changed in zip(pairs, edited, sketches, strict=True)
            ]
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

    return with_next(docs, parts).mapInArrow(tidy(run), RESULT)
