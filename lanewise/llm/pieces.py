"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search walks a text once and keeps, for each place in a window, the last piece of the best path that ends there
and where that piece began.  Ids are committed as soon as all paths that can still grow pass one boundary; what lies
before it leaves the window.  That is so at once where no piece of any path reaches across a place; elsewhere the
paths are followed back until they meet, each time that the window has grown by the longest piece.  No path can grow
from further back than the longest piece.

Unigram models: the best path has the greatest sum of scores.  Byte-pair models define their result by merges instead
of sums; there a path may take a piece only if merging would leave it and the piece before it apart, which depends on
these two alone, and exactly one path to each place fulfils that.  So one search serves both kinds.

Where the vocabulary alone tells that all paths have a boundary, such as before a space that no piece holds inside, the
search starts anew, and what it committed for the run up to there is remembered.
"""

from __future__ import annotations

import hashlib
import re
import struct
import sys
import types
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import adding, restored, through_arrow

SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: About so many bytes of committed runs are remembered in a worker, in two halves of which the older one is forgotten, and
#: so many pairs of pieces.  Runs longer than CACHE_LENGTH aren't kept.
CACHE_BYTES, CACHE_PAIRS, CACHE_LENGTH = 64 << 20, 200_000, 40
#: Bytes of an entry beside its characters and ids: two objects and a place in the table.
_ENTRY = 190
#: Rows of one outgoing batch.
ROWS_OUT = 256
#: Letters, for finding borders that no piece crosses; numbers that count as word characters are left out.
LETTER = "[^\\W\\d_²³¹¼½¾⁰-₉]"
_NEVER = (1 << 31) - 1


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Numbers and values of a protocol buffer's fields."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, struct.unpack("<f" if n == 4 else "<d", data[at : at + n])[0]
            at += n


class PieceModel:
    """What a .model file holds, ready for the search.  Built once, on the driver; its size follows the vocabulary."""

    def __init__(self, data: bytes):
        self.digest = hashlib.md5(data).hexdigest()
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.byte_fallback, self.unk = UNIGRAM, False, 0
        self.dummy_prefix = self.squeeze = self.escape = True
        for field, value in _fields(data):
            if field == 1:
                part = dict(_fields(value))
                self.pieces.append((part.get(1, b"").decode(), part.get(2, 0.0), part.get(3, NORMAL)))
            elif field == 2:
                spec = dict(_fields(value))
                self.kind, self.byte_fallback, self.unk = spec.get(3, UNIGRAM), bool(spec.get(35, 0)), spec.get(40, 0)
                if spec.get(24):
                    raise ValueError("white space as a suffix isn't supported")
            elif field == 3:
                spec = dict(_fields(value))
                self.dummy_prefix, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
                if spec.get(2):
                    raise ValueError("models with a table of character rewrites aren't supported")
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and byte-pair models are supported")
        if any(t == USER_DEFINED for *_, t in self.pieces):
            raise ValueError("user-defined pieces aren't supported")
        self.ids = {p: i for i, (p, _, t) in enumerate(self.pieces) if t == NORMAL}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == BYTE}
        self.scores = [s for _, s, _ in self.pieces]
        self.unk_score = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10
        if self.kind == BPE:
            self._merges()
        self.longest = max(map(len, self.ids), default=1)
        self.raw = [
            bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN
            else p.replace(SPACE, " ").encode()
            for p, _, t in self.pieces
        ]
        # Where no piece crosses from a character to a space, or holds a line feed, every path has a boundary.
        self.cut_space = self.escape and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.cut_line = not any("\n" in p for p in self.ids)
        mixed = re.compile(f"{LETTER}(?!{LETTER}|$)|(?!{LETTER}|{SPACE})(?s:.){LETTER}")
        self.cut_kind = self.cut_space and self.cut_line and not any(mixed.search(p) for p in self.ids)

    def _merges(self) -> None:
        """The order of merges, and for each piece the parts at its left and right edge, the smallest first.

        Parts are numbered; joined gives the rank of the merge of two parts.  Edges lie one after another in flat arrays,
        each a part and the rank of the merge that takes it up.
        """
        order = sorted((i for p, i in self.ids.items() if len(p) > 1), key=lambda i: (-self.scores[i], i))
        same, rank = 0, {}
        for k, i in enumerate(order):
            same = same if k and self.scores[order[k - 1]] == self.scores[i] else k
            rank[self.pieces[i][0]] = same
        number: dict[str, int] = {}
        self.part, self.taken_up = array("i"), array("i")
        self.left_at, self.right_at = (array("i", bytes(4 * len(self.pieces))) for _ in range(2))
        for p, i in list(self.ids.items()):
            parts = list(p)
            left, right = [parts[0]], [parts[-1]]
            while len(parts) > 1:
                best, at = min((rank.get(parts[k] + parts[k + 1], _NEVER), k) for k in range(len(parts) - 1))
                if best == _NEVER:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                left += [parts[0]] * (at == 0)
                right += [parts[-1]] * (at == len(parts) - 1)
            if len(parts) > 1:  # merging never gives this piece
                del self.ids[p]
                continue
            for at, edge in ((self.left_at, left), (self.right_at, right)):
                at[i] = len(self.part)
                self.part.extend(number.setdefault(q, len(number)) for q in edge)
                self.taken_up.extend([*(rank[q] for q in edge[1:]), _NEVER])
        self.parts = len(number)
        self.joined = {
            a * self.parts + b: k
            for p, k in rank.items()
            for cut in range(1, len(p))
            if (a := number.get(p[:cut])) is not None and (b := number.get(p[cut:])) is not None
        }

    def apart(self, a: int, b: int) -> bool:
        """Whether merging leaves pieces a and b side by side: no merge across their border comes before those that
        build them.  Of merges of equal rank the left one comes first."""
        part, taken_up, joined, n = self.part, self.taken_up, self.joined, self.parts
        i, j = self.right_at[a], self.left_at[b]
        up, over = taken_up[i], taken_up[j]
        while True:
            across = joined.get(part[i] * n + part[j], _NEVER)
            if across < up and across <= over and across < _NEVER:
                return False
            if up == over == _NEVER:
                return True
            if up <= over:
                i += 1
                up = taken_up[i]
            else:
                j += 1
                over = taken_up[j]

    def slim(self) -> dict:
        """What encoding and decoding need, for broadcasting."""
        unneeded = {"pieces"} | ({"scores"} if self.kind == BPE else set())
        return {k: v for k, v in vars(self).items() if k not in unneeded}


class Encoder:
    """Encodes texts with one model.  Its caches are bounded and only save time."""

    def __init__(self, model: PieceModel):
        self.model, self.trie = model, {}
        for p, i in model.ids.items():
            children = self.trie
            for c in p:
                entry = children.get(c)
                if entry is None:
                    entry = children[c] = [None, {}]
                children = entry[1]
            entry[0] = i
        self.pairs: dict[int, dict[int, bool]] = {}  # by the first piece, then the second
        self.known = 0
        self.runs: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.room = CACHE_BYTES // 2
        if model.cut_kind:
            split = f"\n| *{LETTER}+| *(?:(?!{LETTER})[^ \n])+| +"
        else:
            cut = "\n" * model.cut_line + " " * model.cut_space
            split = "\n|" * model.cut_line + (f" *[^{cut}]+| +" if model.cut_space else f"[^{cut}]+" if cut else "(?s:.)+")
        self.split = re.compile(split).findall

    def _unknown(self, c: str) -> list[int]:
        m = self.model
        if m.byte_fallback:
            return [m.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")]
        return [m.unk]

    def _fits(self, after: dict[int, bool], before: int, i: int) -> bool:
        if self.known >= CACHE_PAIRS:
            for x in self.pairs.values():
                x.clear()
            self.known = 0
        self.known += 1
        ok = after[i] = before < 0 or self.model.apart(before, i)
        return ok

    def search(self, text: str) -> Iterator[list[int]]:
        """Committed ids of a text, boundary by boundary; a lone unknown character gives its bytes or the unknown id.

        The window holds the places from the last boundary on and the longest piece ahead; so it is bounded but for texts
        whose paths don't meet.
        """
        model, trie, pairs = self.model, self.trie, self.pairs
        bpe, n, longest = model.kind == BPE, len(text), model.longest
        base = w = reach = 0  # the text's place where the window begins; in the window, the present one and the furthest reached
        look = 2 * longest  # the window's size at which paths are followed back
        size = min(n, 3 * longest) + 1
        last: list[int | None] = [None] * size  # -1: the start or an unknown character
        back, score = [0] * size, [0.0] * size
        last[0] = -1
        for j in range(n):
            if w >= longest and (reach == w or w >= look):
                # No path reaches across this place, or those that still grow are followed back to where they meet.
                meet = w if reach == w else self._meeting(last, back, w, reach)
                if meet:
                    yield self._path(text, base, last, back, meet)
                    last, score = last[meet:] + [None] * meet, score[meet:] + [0.0] * meet
                    back = [max(0, k - meet) for k in back[meet:]] + [0] * meet
                    base, w, reach = base + meet, w - meet, reach - meet
                look = w + 2 * longest
                if (more := min(n - base, look + longest) + 1 - len(last)) > 0:
                    last += [None] * more
                    back += [0] * more
                    score += [0.0] * more
            before, k = last[w], w
            entry = trie.get(text[j])
            if entry is None or entry[0] is None:  # no piece, so its own bytes or the unknown id
                if last[w + 1] is None or not bpe and score[w] + model.unk_score > score[w + 1]:
                    last[w + 1], back[w + 1], score[w + 1] = -1, w, score[w] + model.unk_score
                    reach = max(reach, w + 1)
            children = trie
            if bpe:
                after = pairs.get(before)
                if after is None:
                    after = pairs[before] = {}
                for c in text[j : j + longest]:
                    entry = children.get(c)
                    if entry is None:
                        break
                    k += 1
                    i, children = entry
                    if i is not None and last[k] is None:
                        ok = after.get(i)
                        if ok or ok is None and self._fits(after, before, i):
                            last[k], back[k] = i, w
                            if k > reach:
                                reach = k
            else:
                for c in text[j : j + longest]:
                    entry = children.get(c)
                    if entry is None:
                        break
                    k += 1
                    i, children = entry
                    if i is not None and (last[k] is None or score[w] + model.scores[i] > score[k]):
                        last[k], back[k], score[k] = i, w, score[w] + model.scores[i]
                        reach = max(reach, k)
            w += 1
        yield self._path(text, base, last, back, w)

    @staticmethod
    def _meeting(last: list, back: list, w: int, reach: int) -> int:
        """The last place of the window that all paths pass that can still grow."""
        alive = {k for k in range(w, reach + 1) if last[k] is not None}
        while len(alive) > 1:
            top = max(alive)
            alive.remove(top)
            alive.add(back[top])
        return alive.pop()

    def _path(self, text: str, base: int, last: list, back: list, end: int) -> list[int]:
        out: list[int] = []
        while end > 0:
            i, start = last[end], back[end]
            if i >= 0:
                out.append(i)
            else:
                out += reversed(self._unknown(text[base + start]))
            end = start
        out.reverse()
        return out

    def _run(self, text: str) -> tuple[int, ...]:
        """Ids of a run between two places where the vocabulary leaves no piece across."""
        ids = self.runs.get(text)
        if ids is not None:
            return ids
        ids = self.older.get(text)
        if ids is None:
            ids = tuple(chain.from_iterable(self.search(text.replace(" ", SPACE) if self.model.escape else text)))
        if len(text) <= CACHE_LENGTH:
            self.room -= _ENTRY + len(text) * (1 if text.isascii() else 4) + 8 * len(ids)
            if self.room < 0:
                self.older, self.runs, self.room = self.runs, {}, CACHE_BYTES // 2
            self.runs[text] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        m = self.model
        if m.escape and SPACE in text:
            text = text.replace(SPACE, " ")
        if m.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return []
        parts = self.split(" " + text if m.dummy_prefix else text)
        found = list(map(self.runs.get, parts))
        if None in found:
            found = [self._run(p) if x is None else x for p, x in zip(parts, found, strict=True)]
        ids = list(chain.from_iterable(found))
        if not m.byte_fallback and m.unk in ids:  # a run of unknown characters is one id
            ids = [i for k, i in enumerate(ids) if i != m.unk or not k or ids[k - 1] != m.unk]
        return ids

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.model.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


def worker_encoder(shared) -> Encoder:
    """The encoder of a broadcast model in this worker process.  One is kept from task to task, with what it remembers: its
    size is bounded, and a task then needn't learn the frequent words anew.  A lost worker only loses time."""
    kept = sys.modules.setdefault("_lanewise_worker", types.ModuleType("_lanewise_worker"))
    found = getattr(kept, "encoder", None)
    if found is None or found.model.digest != shared.value["digest"]:
        kept.encoder = None
        found = kept.encoder = Encoder(restored(PieceModel, shared))
    return found


def load(path: str) -> PieceModel:
    """Reads a .model file on the driver."""
    with open(path, "rb") as file:
        return PieceModel(file.read())


def encode(docs: DataFrame, model: PieceModel, text: str = "text", check: bool = False) -> DataFrame:
    """All columns of docs and `ids` (array of int); with check also `round_trip`, whether decoding gives the text.

    A null text has no ids and counts as the empty text.  U+2581 stands for a space, so a text with it has no round trip.
    """
    docs, names, schema = adding(docs, **({"ids": "array<int>"} | ({"round_trip": "boolean"} if check else {})))
    shared = docs.sparkSession.sparkContext.broadcast(model.slim())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared)
        for whole in batches:
            # Small batches go out, so what a worker holds doesn't follow the size of those that come in.
            for lo in range(0, whole.num_rows, ROWS_OUT):
                batch = whole.slice(lo, ROWS_OUT)
                ids, counts, same = [], [0], []
                for t in batch.column(names.index(text)).to_pylist():
                    own = encoder.encode(t or "")
                    if check:
                        same.append(encoder.decode(own) == (t or ""))
                    ids.append(np.array(own, np.int32))
                    counts.append(len(own))
                lists = pa.ListArray.from_arrays(pa.array(list(accumulate(counts)), pa.int32()), pa.array(np.concatenate(ids)))
                columns = [*batch.columns, lists] + [pa.array(same, pa.bool_())] * check
                yield pa.RecordBatch.from_arrays(columns, [*names, "ids"] + ["round_trip"] * check)

    return through_arrow(docs, run, schema)


def decode(docs: DataFrame, model: PieceModel, ids: str = "ids", out: str = "text") -> DataFrame:
    """All columns of docs and `out`: the text of the ids.  Null ids give the empty text, as do none."""
    if out == ids:
        raise ValueError("the text needs a column of its own")
    docs, names, schema = adding(docs, **{out: "string"})
    shared = docs.sparkSession.sparkContext.broadcast(model.slim())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared)
        for batch in batches:
            texts = [encoder.decode(x or []) for x in batch.column(names.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, out])

    return through_arrow(docs, run, schema)
