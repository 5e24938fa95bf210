"""Quality classifier: nearest-neighbour voting among labelled documents in a latent semantic space.

A text becomes counts of hashed words, of trigrams of character classes, and of words equal to the one before; they are
damped, weighted by their rarity among labelled texts, and projected on the leading singular directions of the labelled
sample.  All labelled vectors are broadcast; every document's cosines with all of them are computed exactly, block by
block, and the nearest ones vote with weights that grow with similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import adding, restored, through_arrow, tidy
from .samples import bounded, one_text
from .storage import release
from .textnum import WordHasher, text_chunks

CLASSES = 16
#: Class trigrams, then the words that repeat the word before, then hashed words.
SHAPES, WORDS = CLASSES**3 + 1, 4096
TERMS = SHAPES + WORDS
#: Weight of the repeats beside the trigrams, and of all words beside all of those.
REPEAT_WEIGHT, WORD_WEIGHT = 3, 0.5
#: Directions kept, neighbours that vote, and labelled rows of each label at most (about).
RANK, NEIGHBOURS, TRAIN_ROWS = 48, 15, 1500
THRESHOLD = 0.3
_BLOCK = 256


def _classes() -> np.ndarray:
    """Byte to character class; 0 is kept for the edges of a text."""
    table = np.full(256, 14, np.uint8)
    groups = ["", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\f\v", "\n", ".", ",", "!?", "#", "*$%&", "|", "<>[]{}()", "\"'`"]
    for k, group in enumerate(groups):
        for c in group:
            table[ord(c)] = k
    table[128:] = 15
    return table


def term_counts(column: pa.Array) -> Iterator[np.ndarray]:
    """Counts of terms, a (texts, TERMS) block at a time; a text's edges count as a class."""
    table, hasher = _classes(), WordHasher()
    for lo, hi, data, starts in text_chunks(column):
        classes = table[data]
        words, at = hasher.words(data, starts)
        again = np.concatenate([[0], np.cumsum(words[1:] == words[:-1])])
        columns = (words % np.uint64(WORDS)).astype(np.int64)
        for a in range(lo, hi, _BLOCK):
            rows = range(a, min(hi, a + _BLOCK))
            out = np.zeros((len(rows), TERMS), np.float32)
            for k, row in enumerate(rows):
                own = np.zeros(int(starts[row - lo + 1] - starts[row - lo]) + 2, np.uint16)
                own[1:-1] = classes[starts[row - lo] : starts[row - lo + 1]]
                if len(own) > 2:
                    out[k] = np.bincount((own[:-2] * CLASSES + own[1:-1]) * CLASSES + own[2:], minlength=TERMS)
                first, end = at[row - lo], at[row - lo + 1]
                if end > first:
                    out[k, SHAPES - 1] = again[end - 1] - again[first]
                    out[k, SHAPES:] = np.bincount(columns[first:end], minlength=WORDS)
            yield out


def damped(x: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Counts become, in place, unit rows of log-damped shares, weighted by rarity; words and shapes each have their part.
    A text without terms stays zero."""
    for part in (x[:, :SHAPES], x[:, SHAPES:]):
        part *= 1000 / np.maximum(part.sum(axis=1, keepdims=True), 1)
    np.log1p(x, out=x)
    x *= rarity
    x[:, SHAPES - 1] *= REPEAT_WEIGHT
    for part, weight in ((x[:, :SHAPES], 1.0), (x[:, SHAPES:], WORD_WEIGHT)):
        part *= weight / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-12)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return x


@dataclass
class QualityModel:
    rarity: np.ndarray
    directions: np.ndarray  # (TERMS, rank)
    vectors: np.ndarray  # (labelled, rank), unit rows
    labels: np.ndarray
    votes: np.ndarray  # a labelled row stands for so many rows of its label
    prior: float

    def project(self, counts: np.ndarray) -> np.ndarray:
        """Unit rows in the space of the directions."""
        return unit(damped(counts.copy(), self.rarity) @ self.directions)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Share of the votes for label 1.  Texts without terms, and all if there is no neighbour, get the prior.

        Of labelled rows that are equally near at the last place each votes with an equal part of what is left.
        """
        out = np.full(len(counts), self.prior)
        some = np.flatnonzero(counts.any(axis=1))
        if not len(self.labels) or not len(some):
            return out
        # Rounded, so that neither the order of labelled rows nor a block's size decides.
        cosine = np.round(self.project(counts[some]) @ self.vectors.T, 5)
        k = min(NEIGHBOURS, len(self.labels))
        last = np.partition(cosine, -k, axis=1)[:, -k, None]
        nearer, level = cosine > last, cosine == last
        part = nearer + level * ((k - nearer.sum(axis=1, keepdims=True)) / level.sum(axis=1, keepdims=True))
        weight = np.maximum(cosine, 0)
        for _ in range(3):
            weight *= weight
        weight = (weight + 1e-9) * part * self.votes
        out[some] = (weight @ self.labels) / weight.sum(axis=1)
        return np.clip(out, 0, 1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> QualityModel:
    """A model from docs(doc_id, text) and labels(doc_id, label) with label 0 or 1.

    About `most` labels of each kind are picked before any text is read: a fixed bound for what is broadcast, for the
    texts that are shuffled, and for what reaches the driver.  Other labels and null ones are left out; a label given
    twice counts once, an id with both labels counts for both; of rows that share a doc_id the one with the least text
    counts; a null text counts as empty.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for block in term_counts(batch.column(1)):
                found = [np.flatnonzero(row).astype(np.int32) for row in block]
                values = [row[i] for row, i in zip(block, found, strict=True)]
                columns = [batch.column(k).slice(at, len(block)) for k in (0, 2)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(found, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))],
                    ["doc_id", "label", "terms", "counts"],
                )
                at += len(block)

    known = labels.where("label in (0, 1) and doc_id is not null").select("doc_id", F.col("label").cast("int").alias("label")).distinct()
    totals = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    prior = totals.get(1, 0) / sum(totals.values()) if totals else 0.5
    picked = F.broadcast(bounded(known, most, "label"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sample = one_text(texts.join(picked, "doc_id"), "doc_id", "label").select("doc_id", "text", "label").repartition(8)
    found = sample.mapInArrow(tidy(count), "doc_id long, label int, terms array<int>, counts array<float>").toArrow()
    model = _fitted(found, totals, prior)
    del found
    release(docs.sparkSession)
    return model


class Rows:
    """Rows of TERMS values of which few aren't zero.  Only these are kept; a block of rows at a time is spread out."""

    def __init__(self, sizes: np.ndarray, columns: np.ndarray, values: np.ndarray):
        self.starts, self.columns, self.values = np.concatenate([[0], np.cumsum(sizes)]), columns, values

    def __len__(self) -> int:
        return len(self.starts) - 1

    def blocks(self) -> Iterator[tuple[slice, np.ndarray]]:
        for a in range(0, len(self), _BLOCK):
            at = self.starts[a : a + _BLOCK + 1]
            out, rows = np.zeros((len(at) - 1, TERMS), np.float32), np.repeat(np.arange(len(at) - 1), np.diff(at))
            out[rows, self.columns[at[0] : at[-1]]] = self.values[at[0] : at[-1]]
            yield slice(a, a + len(out)), out

    def damped(self, rarity: np.ndarray) -> Rows:
        """damped() of all rows; zeros stay zero."""
        values = np.empty(len(self.values), np.float32)
        for at, block in self.blocks():
            ends = self.starts[at.start : at.stop + 1]
            rows = np.repeat(np.arange(len(block)), np.diff(ends))
            values[ends[0] : ends[-1]] = damped(block, rarity)[rows, self.columns[ends[0] : ends[-1]]]
        return Rows(np.diff(self.starts), self.columns, values)

    def times(self, q: np.ndarray) -> np.ndarray:
        return np.concatenate([block @ q for _, block in self.blocks()])

    def across(self, q: np.ndarray) -> np.ndarray:
        """The transposed rows times q."""
        return sum(block.T @ q[at] for at, block in self.blocks())


def _fitted(found: pa.Table, totals: dict[int, int], prior: float) -> QualityModel:
    """A model from found(doc_id, label, terms, counts).  The driver holds the counts that aren't zero, not a matrix."""
    found = found.sort_by([("doc_id", "ascending"), ("label", "ascending")])
    sizes = pc.list_value_length(found["terms"]).to_numpy()
    columns, values = (pc.list_flatten(found[c]).to_numpy() for c in ("terms", "counts"))
    labels = found["label"].to_numpy().astype(np.float32)[sizes > 0]
    counts = Rows(sizes[sizes > 0], columns, values)
    rarity = np.log((1 + len(counts)) / (1 + np.bincount(columns, minlength=TERMS))).astype(np.float32) + 1
    x = counts.damped(rarity)
    directions = leading_directions(x, RANK)
    shares = np.array([totals.get(k, 0) / max(1, (labels == k).sum()) for k in (0, 1)])
    votes = shares[labels.astype(int)] if len(labels) else np.zeros(0)
    model = QualityModel(rarity, directions, np.zeros((0, directions.shape[1]), np.float32), labels, votes, prior)
    model.vectors = unit(x.times(directions)).astype(np.float32) if len(x) else model.vectors
    return model


def leading_directions(x: Rows, rank: int) -> np.ndarray:
    """The leading right singular vectors of x by subspace iteration from a fixed start, as columns."""
    if not len(x):
        return np.zeros((TERMS, 0), np.float32)
    start = np.random.Generator(np.random.PCG64(5)).standard_normal((TERMS, rank + 16)).astype(np.float32)
    q = np.linalg.qr(x.times(start))[0]
    for _ in range(4):
        q = np.linalg.qr(x.times(np.linalg.qr(x.across(q))[0]))[0]
    _, size, right = np.linalg.svd(x.across(q).T, full_matrices=False)
    good = min(rank, int((size > 1e-5 * size.max(initial=0)).sum()))
    return right[:good].T.astype(np.float32)


def predict(docs: DataFrame, model: QualityModel, text: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """All columns of docs, `score` (0 to 1, higher: label 1 likelier) and `predicted` (1 if score >= 0.3, else 0).

    Columns with the names of these two are replaced.  A null text counts as empty; an empty text gets the share of label
    1 among all labelled rows.  Equal texts have equal scores.
    """
    docs, names, schema = adding(docs, **{score: "double", predicted: "int"})
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = restored(QualityModel, shared)
        for batch in batches:
            column = batch.column(names.index(text)).fill_null("")
            found = np.concatenate([model.score(block) for block in term_counts(column)] or [np.zeros(0)])
            columns = [*batch.columns, pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*names, score, predicted])

    return through_arrow(docs, run, schema)
