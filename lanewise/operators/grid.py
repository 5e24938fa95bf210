"""What a group's readings read in every cell of a grid of numbers of readings, fusions and priors, many groups at once.

The rules are those of voting.consensus and voting.log_odds; sums are added in the order of the readings, as there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.plates import PROVINCES

#: Rows that are judged at once, and characters that are compared as arrays; longer texts are compared one by one.
ROWS, WIDTH = 1 << 17, 16
FAR, LATE = 3, np.iinfo(np.int64).max


def changes(values: pa.Array) -> np.ndarray:
    """Where a value differs from the one before it; nulls equal each other."""
    out = np.ones(len(values), bool)
    if len(values) > 1:
        gone = np.asarray(values.is_null())
        other = np.asarray(pc.fill_null(pc.not_equal(values[1:], values[:-1]), False))
        out[1:] = other | (gone[1:] != gone[:-1])
    return out


def places(starts: np.ndarray) -> np.ndarray:
    """Each row's number from 0 within the run that begins at the last start."""
    at = np.arange(len(starts))
    return at - np.maximum.accumulate(np.where(starts, at, 0))


def near(a: str, b: str) -> int:
    """The edits between two texts, or FAR if there are more than two."""
    if abs(len(a) - len(b)) >= FAR:
        return FAR
    last = [min(j, FAR) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [FAR] * (len(b) + 1)
        if i < FAR:
            row[0] = i
        for j in range(max(1, i - 2), min(len(b), i + 2) + 1):
            row[j] = min(last[j - 1] + (x != b[j - 1]), last[j] + 1, row[j - 1] + 1, FAR)
        last = row
    return last[-1]


class Texts:
    """Different texts in ascending order: their lengths, letters and digits."""

    def __init__(self, texts: pa.Array):
        self.all = texts.to_pylist()
        self.length = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        self.points = np.array(self.all, f"U{WIDTH}").view(np.uint32).reshape(-1, WIDTH) if self.all else np.zeros((0, WIDTH), np.uint32)
        letter, digit = (self.points >= 65) & (self.points <= 90), (self.points >= 48) & (self.points <= 57)
        small, n = (self.points >= 97) & (self.points <= 122), self.length
        self.plausible = (n >= 5) & (n <= 8) & (letter | small).any(1) & (digit.sum(1) >= 2) & ~letter[:, :4].all(1)
        car = letter[:, :3].all(1) & digit[:, 3:6].all(1) & ((n == 6) | (n == 7) & digit[:, 6])
        formed = car | (n == 6) & letter[:, :2].all(1) & digit[:, 2:5].all(1) & letter[:, 5]
        home = np.isin(self.points[:, 0], [ord(c) for c in PROVINCES])
        self.bonus = np.where(formed, 0.15 + np.where(home, 0.05, 0.0), 0.0)
        self.capital = self.points[:, 0] == ord("P")

    def edits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """near() of the texts numbered a and b: the band of two beside the diagonal of the table of edits."""
        out = np.full(len(a), FAR, np.uint8)
        la, lb = self.length[a], self.length[b]
        short = np.abs(la - lb) < FAR
        wide = short & (np.maximum(la, lb) > WIDTH)
        for i in np.flatnonzero(wide):
            out[i] = near(self.all[a[i]], self.all[b[i]])
        pick = np.flatnonzero(short & ~wide)
        if not len(pick):
            return out
        la, lb = la[pick], lb[pick]
        x, y = np.ascontiguousarray(self.points[a[pick]].T), np.ascontiguousarray(self.points[b[pick]].T)
        found, far = np.full(len(pick), FAR, np.uint8), np.full(len(pick), FAR, np.uint8)
        last = {j: np.full(len(pick), j, np.uint8) for j in range(FAR)}
        for j in range(FAR):
            found[(la == 0) & (lb == j)] = j
        for i in range(1, int(la.max(initial=0)) + 1):
            row = {0: np.full(len(pick), i, np.uint8)} if i < FAR else {}
            for j in range(max(1, i - 2), min(WIDTH, i + 2) + 1):
                best = last[j - 1] + (x[i - 1] != y[j - 1])
                best = np.minimum(best, np.minimum(last.get(j, far), row.get(j - 1, far)) + np.uint8(1))
                row[j] = np.minimum(best, far)
            for j, v in row.items():
                here = (la == i) & (lb == j)
                found[here] = v[here]
            last = row
        out[pick] = found
        return out


def distances(code: np.ndarray, texts: Texts) -> np.ndarray:
    """The edits between a group's readings, for each two of them; FAR where one is missing."""
    groups, most = code.shape
    out = np.full((groups, most, most), FAR, np.uint8)
    count = np.int64(len(texts.all))
    pairs = [(i, j) for i in range(most) for j in range(i + 1, most)]
    rows = [np.flatnonzero((code[:, j] >= 0) & (code[:, i] != code[:, j])) for i, j in pairs]
    keys = [np.minimum(code[r, i], code[r, j]) * count + np.maximum(code[r, i], code[r, j]) for r, (i, j) in zip(rows, pairs, strict=True)]
    if pairs and sum(map(len, keys)):
        known, back = np.unique(np.concatenate(keys), return_inverse=True)
        found = texts.edits(known // count, known % count)[back]
        for (i, j), r, d in zip(pairs, rows, np.split(found, np.cumsum([len(k) for k in keys])[:-1]), strict=True):
            out[r, i, j] = out[r, j, i] = d
    return out


def _greatest(code: np.ndarray, among: np.ndarray) -> np.ndarray:
    return np.where(among, code, -1).max(1)


def voted(code: np.ndarray, w: np.ndarray, edits: np.ndarray, texts: Texts, betas: tuple) -> list[np.ndarray]:
    """The number of the text that a vote chooses, for each prior.  A weight that isn't known is -inf."""
    there = code >= 0
    ok = there & texts.plausible[code]
    used = np.where(ok.any(1)[:, None], ok, there)
    own, reads, by_near = np.zeros(code.shape), np.zeros(code.shape), np.zeros(code.shape)
    length = texts.length[code]
    for j in range(code.shape[1]):
        same = (code == code[:, j : j + 1]) & used[:, j : j + 1]
        weight = np.broadcast_to(w[:, j : j + 1], code.shape)
        own += np.where(same, weight, 0.0)
        reads += same
        beside = (edits[:, :, j] < FAR) & used[:, j : j + 1] & used
        if beside.any():
            close = 1 - edits[:, :, j][beside] / np.maximum(length, length[:, j : j + 1])[beside]
            by_near[beside] += np.where(weight[beside] == -np.inf, -np.inf, weight[beside] * close * close * 0.5)
    capital = used & texts.capital[code]
    some = np.flatnonzero(capital.any(1))

    def best(rows, beta: float) -> np.ndarray:
        score = own[rows] + np.where(capital[rows], beta * reads[rows], 0.0) + by_near[rows]
        score = np.where(used[rows], np.where(np.isnan(score), np.inf, score), -np.inf)
        return _greatest(code[rows], used[rows] & (score == score.max(1)[:, None]))

    return _by_prior(best, some, betas)


def summed(code: np.ndarray, odds: np.ndarray, at: np.ndarray, texts: Texts, betas: tuple) -> list[np.ndarray]:
    """The number of the text whose log-odds sum highest, for each prior; -1 where no text has five characters."""
    used = (code >= 0) & (texts.length[code] >= 5)
    capital = used & texts.capital[code]
    some = np.flatnonzero(capital.any(1))
    first = np.full(code.shape, LATE)
    for j in range(code.shape[1]):
        same = (code == code[:, j : j + 1]) & used[:, j : j + 1]
        first = np.where(same, np.minimum(first, at[:, j : j + 1]), first)

    def best(rows, beta: float) -> np.ndarray:
        c, u = code[rows], used[rows]
        score, add = np.zeros(c.shape), odds[rows] + np.where(capital[rows], 2 * beta, 0.0)
        for j in range(c.shape[1]):
            score += np.where((c == c[:, j : j + 1]) & u[:, j : j + 1], add[:, j : j + 1], 0.0)
        score = np.where(u, np.where(np.isnan(score), np.inf, np.rint(score * 1e9)), -np.inf)
        top = u & (score == score.max(1)[:, None])
        early = np.where(top, first[rows], LATE)
        return _greatest(c, top & (early == early.min(1)[:, None]))

    return _by_prior(best, some, betas)


def _by_prior(best: Callable, some: np.ndarray, betas: tuple) -> list[np.ndarray]:
    """best() of all groups, and again for each prior of those that it can change."""
    plain, out = best(slice(None), 0.0), []
    for beta in betas:
        out.append(plain.copy())
        if beta and len(some):
            out[-1][some] = best(some, beta)
    return out


def numbered(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each text's number, and the different texts, in the order of their bytes."""
    coded = pc.dictionary_encode(texts)
    order = pc.array_sort_indices(coded.dictionary.cast(pa.binary())).to_numpy()
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    return number[coded.indices.to_numpy()], coded.dictionary.take(pa.array(order))


def _figures(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers, and which of them are missing."""
    return values.to_numpy(zero_copy_only=False).astype(float), np.asarray(values.is_null())


class Arranged:
    """The readings at some rows by key, model, order, text and figures: their rows, groups and places, texts and figures.
    Nulls come first, what is no number last."""

    def __init__(self, rows: pa.RecordBatch, key: np.ndarray, at: np.ndarray):
        part = rows.take(pa.array(at))
        self.code, self.texts = numbered(part["text"])
        as_read = self.code if part["raw"].null_count == len(part["raw"]) else numbered(pc.coalesce(part["raw"], part["text"]))[0]
        model = pc.dictionary_encode(part["model"], null_encoding="encode").indices.to_numpy().astype(np.int64)
        if pa.types.is_floating(part["at"].type):
            _, rank = np.unique(part["at"].to_numpy(zero_copy_only=False), return_inverse=True)
        else:
            rank = pc.rank(part["at"], null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
        self.seen = np.where(np.asarray(part["at"].is_null()), LATE, rank)
        self.conf, self.no_conf = _figures(part["conf"])
        self.score, self.no_score = _figures(part["score"])
        rank = np.where(self.seen == LATE, -1, rank) + 1
        # One number for what it takes few to tell apart.
        head = key[at] * (model.max() + 1) + model
        tail = rank * (as_read.max() + 1) + as_read
        figures = [v for c, gone in ((self.score, self.no_score), (self.conf, self.no_conf)) for v in ((c, ~gone) if gone.any() else (c,))]
        order = np.lexsort((*figures, tail, head))
        self.rows, head = at[order], head[order]
        for name in ("code", "seen", "conf", "no_conf", "score", "no_score"):
            setattr(self, name, getattr(self, name)[order])
        self.starts = np.ones(len(head), bool)
        self.starts[1:] = head[1:] != head[:-1]
        self.place = places(self.starts)


def cells(rows: pa.RecordBatch, top_k: tuple, betas: tuple) -> Iterator[pa.RecordBatch]:
    """(model, cells, gt, text): for each plate and model the texts that some cells read, the cells as bits in the order
    of the numbers of readings, the priors, and the two fusions; an empty text where a fusion has none.

    rows(k, read, model, at, text, raw, conf, score) come by their key, whole keys only; those without `read` are plates.
    raw is what was read where it isn't text.
    """
    starts = changes(rows["k"])
    read = np.asarray(rows["read"])
    key, most = np.cumsum(starts) - 1, max(top_k)
    truths = np.bincount(key, ~read).astype(np.int64)
    picked = np.flatnonzero(read & (truths[key] > 0))
    if not len(picked):
        return
    found = Arranged(rows, key, picked)
    texts, kept = Texts(found.texts), found.place < most
    g, slot = np.cumsum(found.starts)[kept] - 1, found.place[kept]
    heads = found.rows[found.starts]

    def spread(values: np.ndarray, gap) -> np.ndarray:
        out = np.full((len(heads), most), gap, values.dtype)
        out[g, slot] = values[kept]
        return out

    conf, score = found.conf, found.score
    w = conf * np.maximum(0.1, np.where(found.no_score, 1.0, score) + texts.bonus[found.code])
    c = np.maximum(0.01, np.fmin(0.99, np.where(found.no_conf, 0.99, conf)))
    odds = np.maximum(0.1, np.where(found.no_score, 0.1, score)) * np.log(c / (1 - c))
    code, w, odds, seen = spread(found.code, -1), spread(np.where(found.no_conf, -np.inf, w), 0.0), spread(odds, 0.0), spread(found.seen, LATE)
    size, edits = (code >= 0).sum(1), distances(code, texts)

    wins = np.empty((len(heads), len(top_k), len(betas), 2), np.int64)
    for i, k in enumerate(top_k):
        # Fewer readings than the number before: nothing changes.
        more = np.arange(len(heads)) if i == 0 else np.flatnonzero(size > top_k[i - 1])
        if i:
            wins[:, i] = wins[:, i - 1]
        if len(more):
            part = code[more, :k]
            wins[more, i, :, 0] = np.stack(voted(part, w[more, :k], edits[more, :k, :k], texts, betas), 1)
            wins[more, i, :, 1] = np.stack(summed(part, odds[more, :k], seen[more, :k], texts, betas), 1)
    wins = wins.reshape(len(heads), -1)
    bits = np.int64(1) << np.arange(wins.shape[1])
    alike = (wins == wins[:, :1]).all(1)
    mixed = np.flatnonzero(~alike)
    by_text = np.argsort(wins[mixed], axis=1, kind="stable")
    sorted_wins = np.take_along_axis(wins[mixed], by_text, 1)
    edge = np.ones(sorted_wins.shape, bool)
    edge[:, 1:] = sorted_wins[:, 1:] != sorted_wins[:, :-1]
    edge = np.flatnonzero(edge.ravel())
    joined = np.bitwise_or.reduceat(bits[by_text].ravel(), edge) if len(edge) else edge
    who = np.concatenate([np.flatnonzero(alike), np.repeat(mixed, wins.shape[1])[edge]])
    what = np.concatenate([wins[alike, 0], sorted_wins.ravel()[edge]])
    which = np.concatenate([np.full(alike.sum(), bits.sum()), joined])
    # Each plate of the key.
    row, plates = heads[who], np.flatnonzero(~read)
    times = truths[key[row]]
    plate = plates[np.repeat((np.cumsum(truths) - truths)[key[row]], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
    named = pa.array([*texts.all, ""]).take(pa.array(np.repeat(what, times) % (len(texts.all) + 1)))
    yield pa.record_batch({
        "model": rows["model"].take(pa.array(np.repeat(row, times))), "cells": pa.array(np.repeat(which, times)),
        "gt": rows["text"].take(pa.array(plate)), "text": named,
    })


def winners(top_k: tuple, betas: tuple) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """cells() over a stream of rows by their key, in blocks that end with a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, limit = [], ROWS
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < limit:
                continue
            rows = _whole(held)
            cut = int(np.flatnonzero(changes(rows["k"]))[-1])
            if cut:
                yield from cells(rows.slice(0, cut), top_k, betas)
            held = [_counting(rows.slice(cut), max(top_k))]
            limit = max(ROWS, 2 * held[0].num_rows)
        if sum(b.num_rows for b in held):
            yield from cells(_whole(held), top_k, betas)

    return run


def _counting(rows: pa.RecordBatch, most: int) -> pa.RecordBatch:
    """The plates of a key that goes on, and if it is large, only the readings that may still count."""
    read = np.asarray(rows["read"])
    if read.sum() < ROWS // 2:
        return rows
    found = Arranged(rows, np.zeros(len(read), np.int64), np.flatnonzero(read))
    return rows.take(pa.array(np.concatenate([np.flatnonzero(~read), found.rows[found.place < most]])))


def _whole(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
