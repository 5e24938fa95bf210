"""Language ID: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import adding, restored, through_arrow, tidy
from .samples import bounded, one_text

#: n-grams of one to ORDERS characters, hashed into 2**BITS columns for each order together.
ORDERS, BITS = 3, 15
#: Rows of each language that counts are taken from.
TRAIN_ROWS = 3000
#: Cells of the matrix at most: beyond 256 languages all of them share fewer columns.  So many languages can be told apart.
CELLS, MAX_LANGUAGES = 1 << 23, 1 << 13
UNDETERMINED = "und"
_CHUNK = 1 << 18


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of texts, each with a space before and after, and where each text starts and ends."""
    padded = [f" {t.lower()} " for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in padded])])
    return np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32), starts


def _columns(codes: np.ndarray, order: int, bits: int = BITS) -> np.ndarray:
    """The column of the n-gram that starts at each character; the last order - 1 have none."""
    h = np.full(max(0, len(codes) - order + 1), order, np.uint32)
    for k in range(order):
        h = (h ^ codes[k : k + len(h)]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return (h * np.uint32(0x85EBCA77)) >> np.uint32(32 - bits)


def _chunks(column: pa.Array) -> Iterator[list[str]]:
    """Texts in chunks of about _CHUNK characters, or one longer text."""
    held, size = [], 0
    for k in range(0, len(column), 256):
        for t in column.slice(k, 256).to_pylist():
            held.append(t or "")
            size += len(held[-1])
            if size >= _CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


@dataclass
class LanguageModel:
    languages: list[str]
    log_probability: np.ndarray  # (2**bits, languages), float32
    log_prior: np.ndarray
    bits: int = BITS


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> LanguageModel:
    """A model from docs(doc_id, text, lang) with non-null text and lang, of which `rows` for each language are read.

    Rows without a doc_id are left out: no fold can be told for them.  Of an id that repeats with one language the least
    text counts.  Tasks send one vector of counts for each language they met; the driver's matrix has a bound.
    """
    known = docs.where("doc_id is not null and text is not null and lang is not null").select("doc_id", "text", "lang")
    kept = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()}
    languages = sorted(kept)
    bits = BITS
    while len(languages) << bits > CELLS:
        bits -= 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for lang in set(langs):
                total = totals.setdefault(lang, np.zeros(1 << bits, np.int64))
                for texts in _chunks(batch.column(0).filter(pa.array(langs == lang))):
                    codes, _ = _code_points(texts)
                    for order in range(1, ORDERS + 1):
                        total += np.bincount(_columns(codes, order, bits), minlength=1 << bits)
        out = [list(totals), [v.tobytes() for v in totals.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.binary())], ["lang", "counts"])

    sample = one_text(bounded(known.where(F.col("lang").isin(languages)) if languages else known.limit(0), rows, "lang"), "doc_id", "lang")
    counts = np.zeros((1 << bits, max(1, len(languages))))
    for r in sample.select("text", "lang").repartition(8).mapInArrow(tidy(count), "lang string, counts binary").toLocalIterator():
        counts[:, languages.index(r.lang)] += np.frombuffer(r.counts, np.int64)
    smooth = counts + 0.5
    prior = np.array([kept[x] for x in languages] or [1.0], float)
    return LanguageModel(
        languages, np.log(smooth / smooth.sum(axis=0)).astype(np.float32), np.log(prior / prior.sum()).astype(np.float32), bits
    )


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """All columns of docs, `lang_pred` and `score`, the posterior probability of the prediction (0 to 1).

    A null text and a text without a letter (a character of Unicode category L) are `und` with score 0, as is everything if no language was learned.
    """
    docs, names, schema = adding(docs, lang_pred="string", score="double")
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = restored(LanguageModel, shared)
        by_language = np.ascontiguousarray(model.log_probability.T)
        for batch in batches:
            found, scores = [], []
            for texts in _chunks(batch.column(names.index(text))):
                codes, starts = _code_points(texts)
                sums = np.tile(model.log_prior.astype(np.float64), (len(texts), 1))
                for order in range(1, ORDERS + 1):
                    column = _columns(codes, order, model.bits)
                    # An n-gram that runs into the next text counts for none.
                    for k in range(1, order):
                        across = starts[1:-1] - k
                        column[across[across >= 0]] = 1 << model.bits
                    at = np.minimum(starts[:-1], max(0, len(column) - 1))
                    for lang, row in enumerate(by_language):
                        value = np.append(row, np.float32(0))[column]
                        sums[:, lang] += np.add.reduceat(value, at, dtype=np.float64)
                best = sums.argmax(axis=1)
                odds = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
                for t, k, p in zip(texts, best.tolist(), odds.tolist(), strict=True):
                    known = bool(model.languages) and any(map(str.isalpha, t))
                    found.append(model.languages[k] if known else UNDETERMINED)
                    scores.append(p if known else 0.0)
            columns = [*batch.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "lang_pred", "score"])

    return through_arrow(docs, run, schema)
