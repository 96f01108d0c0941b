"""Removal of repeated passages by a logarithmic family of sparse suffix arrays.

A byte goes if a 50-byte string that covers it also starts in a document with a
smaller doc_id. Suffixes are indexed at anchors chosen by content: the position
of the smallest 20-byte hash in every 50-byte window, about one position in 16, the
same position in equal windows. Two documents that share 50 bytes thus share an
indexed suffix.

1. A filter: tasks emit the fingerprints of the 20 bytes at their anchors, packed by key
   range. In each range the batches' sorted fingerprints are merge-scanned; only suffixes
   whose first 20 bytes stand in another document too go on.
2. These take their windows' bytes along to an exchange by key range. There every new batch
   becomes a suffix array in byte order, is merge-scanned against the levels that
   exist, by the lengths of common prefixes, and is added as a level; levels of equal size merge
   geometrically. All windows but those of the smallest doc_id are marked.
   Contexts without a first window leave the levels: another one stands for them.
3. The marked windows return to their documents and are cut out.

Equal texts are settled before: all but the first copy go whole. Hot keys are
combined inside each flush: one suffix a key leaves it, whatever its number of rows. Very
long texts are hashed whole, 56 bytes of memory for a byte of text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, parallelism, table, text_bytes, tidy, written

#: Length of a match, of the hashed string at an anchor, and anchors a window can choose from.
SPAN, GRAM = 50, 20
REACH = SPAN - GRAM + 1
#: Text bytes hashed at once, held before a flush, and of a key range; the least number of ranges.
CHUNK, FLUSH, RANGE, RANGES = 1 << 19, 1 << 23, 1 << 21, 64
#: Rows of an Arrow batch taken at a time; contexts of a batch of the suffix family.
SLICE, BATCH = 128, 1 << 14
#: Stands for a null doc_id.
NO_ID = -1 << 63
_ODD = np.random.default_rng(20).integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = np.random.default_rng(21).integers(0, 1 << 63, 256, dtype=np.uint64)


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of the 20 bytes from each position."""
    h1 = _BYTE[buf]
    h2 = h1[:-1] * _ODD[0] + h1[1:]
    h4 = h2[:-2] * _ODD[1] + h2[2:]
    h8 = h4[:-4] * _ODD[2] + h4[4:]
    h16 = h8[:-8] * _ODD[3] + h8[8:]
    h = h16[:len(buf) - GRAM + 1] * _ODD[4] + h4[16:16 + len(buf) - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= _ODD[5]
    h ^= h >> np.uint64(29)
    return h


def anchors(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows that choose one anchor, in texts that end at ``ends`` in
    ``buf``: (text number, first window, number of windows, anchor, fingerprint)."""
    if len(buf) < SPAN:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    h = gram_hashes(buf)
    bits = np.uint64(max(26, len(buf).bit_length()))
    v = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)  # the first of equal hashes wins
    for step in (1, 2, 4, 8):
        v = np.minimum(v[:-step], v[step:])
    at = (np.minimum(v[:-(REACH - 16)], v[REACH - 16:]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    inside = np.ones(len(at), bool)
    starts = np.concatenate([[0], ends[:-1]])
    for k in range(1, SPAN):  # windows that run over a text's end
        cut = np.maximum(ends - k, starts)
        inside[cut[(cut < len(at)) & (cut < ends)]] = False
    j = np.flatnonzero(inside)
    if not len(j):
        return j, j, j, j, j.astype(np.uint64)
    p = at[j]
    first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (j[1:] != j[:-1] + 1)]))
    n = np.diff(np.append(first, len(j)))
    key = h[p[first]]  # a smallest hash: mixed again, or the low key ranges would get most
    key = (key ^ (key >> np.uint64(31))) * _ODD[15]
    key = (key ^ (key >> np.uint64(29))) * _ODD[6]
    return np.searchsorted(ends, j[first], side="right"), j[first], n, p[first], key ^ (key >> np.uint64(32))


class Texts:
    """Rows of a task as (row, UTF-8 text) in groups of CHUNK bytes, flushed at FLUSH
    bytes; a few rows of an Arrow batch are Python objects at a time."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.batches = batches

    def __iter__(self) -> Iterator[tuple[list[tuple[dict, bytes]], bool]]:
        rows, size, held = [], 0, 0
        for batch in self.batches:
            for at in range(0, batch.num_rows, SLICE):
                for r in batch.slice(at, SLICE).to_pylist():
                    raw = r.pop("text").encode()
                    rows.append((r, raw))
                    size += len(raw)
                    held += len(raw)
                    if size >= CHUNK:
                        yield rows, held >= FLUSH
                        rows, size, held = [], 0, held if held < FLUSH else 0
        yield rows, True

    @staticmethod
    def joined(rows) -> tuple[bytes, np.ndarray]:
        return b"".join(raw for _, raw in rows), np.cumsum([len(raw) for _, raw in rows], dtype=np.int64)


def _range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def _pieces(order_by: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    if len(order_by):
        cut = np.flatnonzero(np.concatenate([[True], order_by[1:] != order_by[:-1]]))
        yield from zip(cut, np.append(cut[1:], len(order_by)), strict=True)


def _index_rows(ranges: int):
    """Pass 1: packed anchors by key range; hits inside the flush under negative ranges."""
    def flush(docs: list[np.ndarray], keys: list[np.ndarray]) -> pa.RecordBatch | None:
        doc, h = np.concatenate(docs or [np.zeros(0, np.int64)]), np.concatenate(keys or [np.zeros(0, np.uint64)])
        if not len(h):
            return None
        key = (_range_of(h, ranges) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        once = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
        key, doc = key[once], doc[once]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(key)))
        shared = np.repeat(doc[np.append(at[1:], len(key)) - 1] != doc[at], n)
        out: dict[str, list] = {"part": [], "docs": [], "keys": []}
        k, d = key[at], doc[at]
        part = (k >> np.uint64(32)).astype(np.int64)
        for a, b in _pieces(part):
            out["part"].append(part[a])
            out["docs"].append(d[a:b].tobytes())
            out["keys"].append(k[a:b].astype(np.uint32).tobytes())
        if shared.any():
            hit_doc, hit_key = doc[shared], key[shared]
            spread = hit_doc % ranges
            order = np.argsort(spread, kind="stable")
            for a, b in _pieces(spread[order]):
                out["part"].append(-1 - int(spread[order][a]))
                out["docs"].append(hit_doc[order[a:b]].tobytes())
                out["keys"].append(hit_key[order[a:b]].tobytes())
        return pa.RecordBatch.from_pydict(out, pa.schema([("part", pa.int64()), ("docs", pa.binary()), ("keys", pa.binary())]))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, keys = [], []
        copies: dict[bytes, int] = {}
        for rows, last in Texts(batches):
            # A copy of a text with a smaller doc_id in the flush has nothing to add.
            rows = [(r, raw) for r, raw in rows if (seen := copies.get(raw)) is None or seen >= r["doc_id"]]
            copies.update((raw, r["doc_id"]) for r, raw in rows)
            raw, ends = Texts.joined(rows)
            text, _, _, _, h = anchors(np.frombuffer(raw, np.uint8), ends)
            ids = np.array([r["doc_id"] for r, _ in rows], np.int64)
            docs.append(ids[text])
            keys.append(h)
            if last:
                if (out := flush(docs, keys)) is not None:
                    yield out
                docs, keys = [], []
                copies.clear()
    return run


class Family:
    """Levels of sorted fingerprints of the filter: keys, one doc a key, and whether it is a hit."""

    def __init__(self):
        self.levels: list[list[np.ndarray]] = []
        self.hits: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, docs: np.ndarray) -> None:
        """Merge-scan a new sorted array against every level, then add it."""
        hit = np.zeros(len(keys), bool)
        for old_keys, old_docs, old_hit in self.levels:
            at = np.minimum(np.searchsorted(old_keys, keys), len(old_keys) - 1)
            same = np.flatnonzero((old_keys[at] == keys) & (old_docs[at] != docs))
            hit[same] = True
            old_hit[at[same]] = True
        self.levels.append([keys, docs, hit])
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            self._merge()

    def _merge(self) -> None:
        (k1, d1, h1), (k2, d2, h2) = self.levels.pop(), self.levels.pop()
        keys, docs, hit = np.concatenate([k2, k1]), np.concatenate([d2, d1]), np.concatenate([h2, h1])
        order = np.argsort(keys, kind="stable")
        keys, docs, hit = keys[order], docs[order], hit[order]
        again = np.concatenate([[False], keys[1:] == keys[:-1]])  # levels hold a key once: at most two are equal here
        self.hits.append((keys[again & hit], docs[again & hit]))
        first = np.flatnonzero(again) - 1
        hit[first] |= hit[first + 1]
        self.levels.append([keys[~again], docs[~again], hit[~again]])

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        every = [*self.hits, *((k[h], d[h]) for k, d, h in self.levels)]
        return np.concatenate([k for k, _ in every]), np.concatenate([d for _, d in every])


def _by_doc(docs: np.ndarray, keys: np.ndarray) -> pd.DataFrame:
    order = np.argsort(docs, kind="stable")
    docs, keys = docs[order], keys[order]
    bounds = list(_pieces(docs))
    return pd.DataFrame({"doc_id": [docs[a] for a, _ in bounds], "keys": [keys[a:b].tobytes() for a, b in bounds]})


def _scan_range(pdf: pd.DataFrame) -> pd.DataFrame:
    give_back()  # of the range before
    part = int(pdf["part"].iloc[0])
    if part < 0:
        return _by_doc(np.frombuffer(b"".join(pdf["docs"]), np.int64), np.frombuffer(b"".join(pdf["keys"]), np.uint64))
    batches = sorted(((np.frombuffer(d, np.int64), np.frombuffer(k, np.uint32)) for d, k in zip(pdf["docs"], pdf["keys"], strict=True)),
                     key=lambda b: (b[0].min(), len(b[0]), b[0][0], b[1][0]))
    family = Family()
    for docs, keys in batches:
        family.add(keys, docs)
    keys, docs = family.found()
    return _by_doc(docs, keys.astype(np.uint64) | np.uint64(part << 32))


WINDOWS = "part long, docs binary, rids binary, starts binary, more binary, sizes binary, backs binary, keys binary, bytes binary"
KINDS = {"docs": np.int64, "rids": np.int64, "starts": np.int32, "more": np.int32, "sizes": np.uint8, "backs": np.uint8, "keys": np.uint32}


def _window_rows(ranges: int):
    """Pass 2: the bytes around each hit, by key range. Of equal contexts inside a flush
    those of the smallest doc_id go on, the others are repeats (negative ranges).
    A context's places in a text that lie at most SPAN apart (periodic texts) are one
    row from the first to the last: for each window, their spans join."""
    def packed(part: int, rows: list[tuple], context: bytes) -> tuple:
        """rows: (doc_id, rid, first place, from there to the last place, length, back, key)"""
        return (part, *(np.array(c, kind).tobytes() for c, kind in zip(zip(*rows, strict=True), KINDS.values(), strict=True)), context)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[int, list]] = {}  # (key, back, bytes) -> doc_id, its [rid, first, last]
        done: list[tuple[int, int, int, int, int]] = []  # doc_id, rid, first, last, length

        def flush() -> pa.RecordBatch | None:
            by_part: dict[int, tuple[list, list]] = {}
            for (key, back, context), (doc, places) in held.items():
                rows, contexts = by_part.setdefault(key >> 32, ([], []))
                rows.extend((doc, rid, a, b - a, len(context), back, key & 0xFFFFFFFF) for rid, a, b in places)
                contexts.extend([context] * len(places))
            for doc, rid, a, b, n in done:
                by_part.setdefault(-1 - doc % ranges, ([], []))[0].append((doc, rid, a, b - a, n, 0, 0))
            held.clear()
            done.clear()
            out = [packed(p, rows, b"".join(contexts)) for p, (rows, contexts) in by_part.items()]
            names = [c.split()[0] for c in WINDOWS.split(", ")]
            return pa.RecordBatch.from_pydict({c: [r[i] for r in out] for i, c in enumerate(names)}, pa.schema(
                [(c, pa.binary() if i else pa.int64()) for i, c in enumerate(names)])) if out else None

        for rows, last in Texts(batches):
            raw, ends = Texts.joined(rows)
            text, first, n, at, h = anchors(np.frombuffer(raw, np.uint8), ends)
            key = (_range_of(h, ranges) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
            lists = [np.frombuffer(b"".join(r["keys"]), np.uint64) for r, _ in rows]
            owner = np.repeat(np.arange(len(rows), dtype=np.uint64), [len(x) for x in lists])
            wanted = np.concatenate([np.zeros(0, np.uint64), *lists]) * _ODD[6] + owner * _ODD[7]
            take = np.flatnonzero(np.isin(key * _ODD[6] + text.astype(np.uint64) * _ODD[7], wanted))
            begin = np.concatenate([[0], ends[:-1]]).tolist()
            for i, s, m, p, k in zip(*(x[take].tolist() for x in (text, first, n, at, key)), strict=True):
                own, rid, stop = rows[i][0]["doc_id"], rows[i][0]["rid"], s + m + SPAN - 1
                same, place = (k, p - s, raw[s:stop]), s - begin[i]
                doc, places = held.setdefault(same, (own, []))
                if doc < own:
                    done.append((own, rid, place, place, stop - s))
                elif doc > own:
                    done.extend((doc, *x, stop - s) for x in places)
                    held[same] = (own, [[rid, place, place]])
                elif places and places[-1][0] == rid and 0 <= place - places[-1][2] <= SPAN:
                    places[-1][2] = place
                else:
                    places.append([rid, place, place])
            if last and (out := flush()) is not None:
                yield out
    return run


def _strings(blob: np.ndarray, first: np.ndarray, n: np.ndarray, step: int, width: int) -> np.ndarray:
    """For each row the ``n`` bytes from ``first`` on (backwards if ``step`` is -1), filled with zeros to ``width``."""
    out = np.zeros((len(first), width), np.uint8)
    reach = np.arange(width)
    for a in range(0, len(first), BATCH):
        part = slice(a, a + BATCH)
        inside = reach < n[part, None]
        out[part][inside] = blob[(first[part, None] + step * reach)[inside]]
    return out.view(f"S{width}").ravel()


def _prefixes(ordered: np.ndarray, width: int) -> np.ndarray:
    """Length of the common prefix of each string but the first with the one before it."""
    chars = ordered.view(np.uint8).reshape(-1, width)
    other = chars[1:] != chars[:-1]
    return np.where(other.any(axis=1), other.argmax(axis=1), width)


class SuffixFamily:
    """A logarithmic family of sparse suffix arrays over contexts of anchors.

    A suffix array is an array of context numbers in the byte order of the suffixes that begin at
    the anchors (their first SPAN bytes; no window reaches further). Every window of a context is
    ``back`` bytes left of its anchor and SPAN - ``back`` bytes of its suffix: two windows are equal
    if the suffixes' common prefix and that of the bytes read leftwards are as long. Marks in
    ``gone`` (context, window + 1) the windows that also are in a document with a smaller id.
    """

    def __init__(self, blob: np.ndarray, at: np.ndarray, sizes: np.ndarray, backs: np.ndarray, keys: np.ndarray, docs: np.ndarray):
        self.keys, self.docs, self.n_left, self.n_right = keys, docs, backs, sizes - backs
        self.right = _strings(blob, at + backs, self.n_right, 1, SPAN)
        self.left = _strings(blob, at + backs - 1, backs, -1, REACH)
        self.gone = np.zeros((len(keys), REACH + 2), np.int8)
        self.levels: list[np.ndarray] = []

    def add(self, batch: np.ndarray) -> None:
        """Sort a batch of contexts into a suffix array, merge-scan it against the levels, add it as a level."""
        batch = batch[np.argsort(self.right[batch], kind="stable")]
        known = np.unique(self.keys[batch])
        met = [level[np.isin(self.keys[level], known)] for level in self.levels]
        self._scan(self._merged([*met, batch]))
        self.levels.append(self._first(batch))
        while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
            one, two = self.levels.pop(), self.levels.pop()
            self.levels.append(self._first(self._merged([two, one])))

    def _merged(self, arrays: list[np.ndarray]) -> np.ndarray:
        rows = np.concatenate(arrays)
        return rows[np.argsort(self.right[rows], kind="stable")]  # sorted runs: a merge

    def _first(self, rows: np.ndarray) -> np.ndarray:
        """Without the contexts all of whose windows are repeats: smaller documents stand for them."""
        return rows[self.gone[rows].sum(axis=1) < self.n_left[rows] + self.n_right[rows] - SPAN + 1]

    def _scan(self, rows: np.ndarray) -> None:
        if len(rows) < 2:
            return
        docs, n_left, n_right = self.docs[rows], self.n_left[rows], self.n_right[rows]
        prefix = _prefixes(self.right[rows], SPAN)
        by_left = np.argsort(self.left[rows], kind="stable")
        before = _prefixes(self.left[rows[by_left]], REACH)
        lefts = np.zeros(len(rows), np.int64)
        for back in range(REACH):
            e = np.flatnonzero((n_left >= back) & (n_right >= SPAN - back))
            if len(e) < 2:
                continue
            rights = np.concatenate([[0], np.cumsum(prefix < SPAN - back)])
            lefts[by_left[1:]] = np.cumsum(before < back)
            same = rights[e] * len(rows) + lefts[e]
            order = np.lexsort((docs[e], same))
            new = np.concatenate([[True], same[order][1:] != same[order][:-1]])
            least = docs[e][order][new][np.cumsum(new) - 1]
            hit = e[order[docs[e][order] > least]]
            self.gone[rows[hit], n_left[hit] - back + 1] = 1


def _match_range(pdf: pd.DataFrame) -> pd.DataFrame:
    """(doc_id, rid, spans): int64 pairs of the byte ranges that windows of this key range cover."""
    give_back()
    docs, rids, starts, more, sizes, backs, keys = (np.frombuffer(b"".join(pdf[c]), kind) for c, kind in KINDS.items())
    starts, sizes = starts.astype(np.int64), sizes.astype(np.int64)
    lasts = starts + more
    if pdf["part"].iloc[0] < 0:
        spans = np.stack([docs, rids, starts, lasts + sizes], axis=1)
    else:
        blob = np.frombuffer(b"".join(pdf["bytes"]), np.uint8)
        order = np.lexsort((docs, keys))
        new = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
        least, most = docs[order][new], docs[order][np.append(new[1:], len(order)) - 1]
        shared = np.zeros(len(order), bool)
        shared[order] = np.repeat(least != most, np.diff(np.append(new, len(order))))
        at = np.concatenate([[0], np.cumsum(sizes)[:-1]])[shared]
        docs, rids, starts, lasts, sizes, keys = (c[shared] for c in (docs, rids, starts, lasts, sizes, keys))
        family = SuffixFamily(blob, at, sizes, backs[shared].astype(np.int64), keys, docs)
        for a in range(0, len(docs), BATCH):
            family.add(np.arange(a, min(a + BATCH, len(docs))))
        edge = np.diff(family.gone, axis=1)
        row, w = np.nonzero(edge == 1)
        _, past = np.nonzero(edge == -1)
        spans = np.stack([docs[row], rids[row], starts[row] + w, lasts[row] + past - 1 + SPAN], axis=1)
    spans = spans[np.lexsort((spans[:, 2], spans[:, 1], spans[:, 0]))]
    bounds = list(_pieces(_group_number(spans[:, :2])))
    return pd.DataFrame({"doc_id": [spans[a, 0] for a, _ in bounds], "rid": [spans[a, 1] for a, _ in bounds],
                         "spans": [union(spans[a:b, 2:]).tobytes() for a, b in bounds]})


def _group_number(pairs: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate([[0], (pairs[1:] != pairs[:-1]).any(axis=1)])) if len(pairs) else np.zeros(0, np.int64)


def union(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of (start, end) rows; runs that touch become one."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    upto = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > upto[:-1]]))
    return np.ascontiguousarray(np.stack([spans[new, 0], upto[np.append(new[1:], len(spans)) - 1]], axis=1))


def whole_characters(raw: bytes, spans: np.ndarray) -> np.ndarray:
    """The spans without the characters that they hold only in part."""
    out = []
    for a, b in spans.tolist():
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return np.array(out, np.int64).reshape(-1, 2)


def _cut(characters: bool):
    def spans_of(raw: bytes, lists: list[bytes] | None, whole: int | None) -> np.ndarray:
        spans = np.array([[0, len(raw)]]) if whole is not None else union(np.frombuffer(b"".join(lists or ()), np.int64).reshape(-1, 2))
        return whole_characters(raw, spans) if characters else spans

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4 * SLICE):
                part = batch.slice(at, 4 * SLICE)
                starts, ends, kept = [], [], []
                for text, lists, whole in zip(*(part.column(c).to_pylist() for c in ("text", "spans", "all")), strict=True):
                    raw = text.encode()
                    spans = spans_of(raw, lists, whole)
                    starts.append(spans[:, 0].tolist())
                    ends.append(spans[:, 1].tolist())
                    kept.append(b"".join(raw[a:b] for a, b in zip([0, *ends[-1]], [*starts[-1], len(raw)], strict=True)))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("doc_id", "others", "n_bytes")), pa.array(starts, pa.list_(pa.int64())),
                     pa.array(ends, pa.list_(pa.int64())), pa.array(kept, pa.binary())], ["doc_id", "others", "n_bytes", "starts", "ends", "kept"])
    return run


def remove_repeats(docs: DataFrame, keep: tuple[str, ...] = (), characters: bool = False) -> DataFrame:
    """doc_id, the ``keep`` columns, n_bytes, starts, ends, kept: one row for every
    row of ``docs`` (doc_id, text), with the removed byte runs and the bytes left.

    Matches are judged on the input texts and never cross documents. With
    ``characters``, a character that a run holds in part stays, so that the kept bytes
    are a text. Null texts are empty. Rows of one doc_id are one document: none is
    removed for the other's sake. A row without a doc_id is left whole and is
    no source.
    """
    spark = docs.sparkSession
    own = F.col("doc_id").cast("long")
    others = F.struct(own.alias("id"), F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(0).alias("none ")).alias("rest"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sha = F.unhex(F.sha2(text, 256))
    # Keys are never null: a join on them then filters neither side, and both read one exchange.
    every = (docs.select(F.coalesce(own, F.lit(NO_ID)).alias("doc_id"), others.alias("others"), text.alias("text"), sha.alias("sha"))
             .withColumn("rid", F.xxhash64("doc_id", "sha")))
    named = every.where(F.col("doc_id") != NO_ID)
    narrow = written(named.select("doc_id", "rid", "sha", text_bytes("text").alias("n_bytes")), "repeat-rows")
    ranges = max(RANGES, parallelism(spark), -(-(narrow.agg(F.sum("n_bytes")).first()[0] or 0) // RANGE))
    dealt = max(parallelism(spark), ranges // 2)  # tasks of key ranges: their number follows from the bytes
    firsts = written(narrow.groupBy("sha").agg(F.min("doc_id").alias("first")), "repeat-firsts")
    marked = written(narrow.join(firsts, "sha").select("doc_id", "rid", "n_bytes", (F.col("doc_id") == F.col("first")).alias("is_first")), "repeat-marks")

    index = named.select("doc_id", "text").mapInArrow(_index_rows(ranges), "part long, docs binary, keys binary")
    hits = index.repartition(dealt, "part").groupBy("part").applyInPandas(_scan_range, "doc_id long, keys binary")
    touched = written(marked.where("is_first").select("doc_id", "rid").distinct().join(
        hits.groupBy("doc_id").agg(F.collect_list("keys").alias("keys")), "doc_id"), "repeat-hits")

    # The texts are dealt by (doc_id, rid) once: both joins read the same exchange.
    texts = every.select("doc_id", "rid", "others", "text")
    windows = (texts.join(touched.hint("merge"), ["doc_id", "rid"]).select("doc_id", "rid", "others", "text", "keys")
               .mapInArrow(_window_rows(ranges), WINDOWS))
    found = windows.repartition(dealt, "part").groupBy("part").applyInPandas(_match_range, "doc_id long, rid long, spans binary")
    copies = marked.where(~F.col("is_first") & (F.col("n_bytes") >= SPAN)).distinct().select(
        "doc_id", "rid", F.lit(None).cast("binary").alias("spans"), F.col("n_bytes").alias("all"))
    spans = (found.withColumn("all", F.lit(None).cast("long")).union(copies)
             .groupBy("doc_id", "rid").agg(F.collect_list("spans").alias("spans"), F.max("all").alias("all")))
    joined = texts.join(spans.hint("merge"), ["doc_id", "rid"], "left")
    rows = joined.select("doc_id", "others", "text", "spans", "all").withColumn("n_bytes", text_bytes("text"))
    schema = (T.StructType().add("doc_id", "long").add("others", rows.schema["others"].dataType).add("n_bytes", "long")
              .add("starts", T.ArrayType(T.LongType())).add("ends", T.ArrayType(T.LongType())).add("kept", "binary"))
    done = rows.mapInArrow(_cut(characters), schema)
    return done.select(F.col("others.id").alias("doc_id"), *[F.col(f"others.rest.`{c}`").alias(c) for c in keep], "n_bytes", "starts", "ends", "kept")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                       F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
