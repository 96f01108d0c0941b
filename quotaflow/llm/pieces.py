"""SentencePiece encoding and decoding for merge-type vocabularies.

A text (spaces as U+2581, one more in front) starts as single characters. An
agenda, ordered by piece score and then by position, holds the adjacent pairs
whose concatenation is a piece; the best pair is merged until none is left.
Characters outside the vocabulary become byte pieces. Merges cannot cross two
characters that stand side by side in no piece, so a text falls into segments
that are encoded alone and remembered. The new segments of some rows are merged
together, each with its own agenda as a row of a matrix. Every new segment is
checked against the sentencepiece library within its Arrow batch.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, tidy

SPACE = "▁"
#: A worker holds at most about twice this many segments: when it has come by so many, those
#: that it held before and did not meet again are forgotten.
REMEMBERED = 150_000
#: Segments of at most this many characters, all of them in the vocabulary, are merged together.
SHORT = 32
#: Rows of an Arrow batch are encoded in runs of about this many characters.
RUN = 1 << 19
#: Segments whose agendas stand in one matrix.
TOGETHER = 4096
MODEL = "piece_bpe_32k.model"
#: Bits of an agenda key that hold the position.
PLACE = 40
#: The rank of a pair that makes no piece.
NEVER = 1 << 62


class PieceModel(dict):
    """Segment -> ids as int32 bytes, filled as segments come up. A segment decodes to itself with its space
    marks as spaces; ``odd`` has the texts of those that do not."""

    def __init__(self, proto: bytes):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        every = range(sp.vocab_size())
        self.text = [sp.id_to_piece(i) for i in every]
        if any(sp.is_unused(i) for i in every):
            raise ValueError("vocabularies with unused pieces are not supported")
        self.ids = {self.text[i]: i for i in every if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        # Agenda keys are one integer: the score's order above, the position below.
        order = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in self.ids.values()}, reverse=True))}
        self.rank = {p: order[sp.get_score(i)] << PLACE for p, i in self.ids.items() if len(p) > 1}
        self.byte = {i: int(self.text[i][3:5], 16) for i in every if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte.items()}
        self.plain = [None if i in self.byte else t.replace(SPACE, " ") for i, t in enumerate(self.text)]
        self.plain[sp.unk_id()] = " ⁇ "
        self.unknown, self.last = sp.unk_id(), np.array([sp.eos_id()], np.int32).tobytes()
        self.split = re.compile(self._segments(), re.S)
        self.unchecked: list[str] = []
        self.older: dict[str, bytes] = {}
        self.odd: dict[str, str] = {}

    def forget(self, everything: bool = False) -> None:
        """Segments not met since the last call go."""
        self.older = {} if everything else self.copy()
        self.clear()
        self.odd = {s: t for s, t in self.odd.items() if s in self.older}

    def _segments(self) -> str:
        """A pattern whose matches never share a merge with their neighbours."""
        beside = {(a, b) for p in self.rank for a, b in pairwise(p)}
        joined = {c for pair in beside for c in pair} - {SPACE}
        words = {c for c in joined if c.isalnum()}
        if any(b == SPACE != a for a, b in beside):  # pieces that go on after a space: only lone characters split
            return f"[{SPACE}{re.escape(''.join(sorted(joined)))}]+|."
        if any((a in words) != (b in words) for a, b in beside if SPACE not in (a, b)):
            parts = [joined]
        else:
            parts = [words, joined - words]
        sets = [f"[{re.escape(''.join(sorted(s)))}]+" for s in parts if s]
        return f"{SPACE}*(?:{'|'.join(sets)})|{SPACE}+(?=[^{SPACE}]|$)|." if sets else "."

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of pieces that make a piece: their sorted keys, that piece's id and its
        place in the order of scores; last, a key that no pair has."""
        wide = len(self.text) + 1
        found = sorted((self.ids[p[:k]] * wide + self.ids[p[k:]], self.ids[p], r >> PLACE)
                       for p, r in self.rank.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids)
        key, made, place = np.array([*found, (wide * wide, 0, 0)], np.int64).T.copy()
        place[-1] = NEVER
        return key, made, place

    @cached_property
    def letters(self) -> dict[str, int]:
        """The vocabulary's lone characters."""
        return {p: i for p, i in self.ids.items() if len(p) == 1}

    def merge_together(self, segs: list[str]) -> Iterator[bytes]:
        """Ids, as int32 bytes, of segments whose characters are all in the vocabulary. Row k of the agenda has
        the ranks of the pairs of segment k; each round merges every row's least, the first of
        equal ones. A column without a piece ends each row, so that no row meets the next."""
        key, made, place = self.pairs
        none = len(self.text)

        def look(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            pair = left * (none + 1) + right
            at = np.searchsorted(key, pair)
            at[key[at] != pair] = len(key) - 1
            return made[at], place[at]

        n, wide = len(segs), max(map(len, segs)) + 1
        part = np.full(n * wide, none, np.int64)
        size = np.fromiter(map(len, segs), np.int64, n)
        inside = (np.arange(wide) < size[:, None]).ravel()
        part[inside] = np.fromiter(map(self.letters.__getitem__, "".join(segs)), np.int64, int(size.sum()))
        before, after = np.arange(n * wide) - 1, np.arange(n * wide) + 1
        made_of, agenda = np.zeros(n * wide, np.int64), np.full(n * wide, NEVER)
        first = np.flatnonzero(inside)
        made_of[first], agenda[first] = look(part[first], part[first + 1])
        rows = np.arange(n)
        while rows.size:
            ranks = agenda.reshape(n, wide)[rows]
            best = ranks.argmin(axis=1)
            go = ranks[np.arange(rows.size), best] != NEVER
            rows = rows[go]
            i = rows * wide + best[go]
            j = after[i]
            part[i], part[j], agenda[j] = made_of[i], none, NEVER
            after[i] = k = after[j]
            before[k] = i
            h = before[i]
            made_of[i], agenda[i] = look(part[i], part[k])
            made_of[h], agenda[h] = look(part[h], part[i])
        left = part != none
        raw, ends = part[left].astype(np.int32).tobytes(), (4 * np.cumsum(left.reshape(n, wide).sum(axis=1))).tolist()
        for a, b in pairwise([0, *ends]):
            yield raw[a:b]

    def merge(self, seg: str) -> list[int]:
        """Ids of a segment, by the agenda of adjacent pairs."""
        n = len(seg)
        part: list[str | None] = list(seg)
        if n > 1:
            rank, push, pop = self.rank.get, heapq.heappush, heapq.heappop
            before, after = list(range(-1, n - 1)), list(range(1, n + 1))
            agenda = [r + i for i, (a, b) in enumerate(pairwise(seg)) if (r := rank(a + b)) is not None]
            heapq.heapify(agenda)
            while agenda:
                key = pop(agenda)
                i = key & (1 << PLACE) - 1
                if (left := part[i]) is None or (j := after[i]) >= n or rank(p := left + part[j]) != key - i:
                    continue  # one of the two has been merged since
                part[i], part[j] = p, None
                after[i] = k = after[j]
                if k < n:
                    before[k] = i
                    if (r := rank(p + part[k])) is not None:
                        push(agenda, r + i)
                if (h := before[i]) >= 0 and (r := rank(part[h] + p)) is not None:
                    push(agenda, r + h)
        out: list[int] = []
        for p in part:
            if p is None:
                continue
            if (i := self.ids.get(p)) is not None:
                out.append(i)
            elif self.byte_id:
                out += [self.byte_id[b] for b in p.encode()]
            else:
                out.append(self.unknown)
        return out

    def unmerge(self, ids: list[int]) -> str:
        """Text of a segment's ids: pieces, runs of byte pieces as UTF-8, spaces back."""
        whole = [self.plain[i] for i in ids]
        if None not in whole:
            return "".join(whole)
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte:
                run.append(self.byte[i])
                continue
            out.append(run.decode(errors="replace"))
            run.clear()
            out.append(self.plain[i])
        out.append(run.decode(errors="replace"))
        return "".join(out)

    def learn(self, segs: set[str]) -> None:
        """Hold all of ``segs``."""
        new, alone, known = [], [], frozenset(self.letters).issuperset
        for s in segs - self.keys():
            if (found := self.older.pop(s, None)) is not None:
                self[s] = found
            elif len(s) <= SHORT and known(s):
                new.append(s)
            else:
                alone.append(s)
        new.sort(key=len)
        for at in range(0, len(new), TOGETHER):
            some = new[at:at + TOGETHER]
            self.update(zip(some, self.merge_together(some), strict=True))
        for s in alone:
            ids = self.merge(s)
            self[s] = array("i", ids).tobytes()
            if (text := self.unmerge(ids)) != s.replace(SPACE, " "):
                self.odd[s] = text
        self.unchecked += new + alone

    def __missing__(self, seg: str) -> bytes:
        self.learn({seg})
        return self[seg]

    def check(self) -> None:
        """Compare the new segments with the library's ids and texts."""
        lead = array("i", self.library.encode("\n")).tobytes()
        for plain in (False, True):
            segs = [s for s in self.unchecked if s.startswith(SPACE) != plain]
            texts = ["\n" + s if plain else s[1:].replace(SPACE, " ") for s in segs]
            known = self.library.encode(texts, num_threads=1)
            for s, theirs in zip(segs, known, strict=True):
                raw = lead + self[s] if plain else self[s]
                # A lone space mark is the dummy prefix of an empty text, which the library leaves out.
                if raw != array("i", theirs).tobytes() and s != SPACE:
                    raise ValueError(f"the library encodes {s!r} as {theirs}, not {array('i', raw).tolist()}")
        self.unchecked.clear()

    def segments(self, text: str) -> list[str]:
        return self.split.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def joined(self, text: str, segs: list[str]) -> tuple[bytes, str]:
        raw = b"".join([self[s] for s in segs]) + self.last
        if self.odd and not self.odd.keys().isdisjoint(segs):
            return raw, "".join([self.odd.get(s) or s.replace(SPACE, " ") for s in segs])[1:]
        return raw, text.replace(SPACE, " ")

    def encode(self, text: str) -> tuple[bytes, str]:
        """int32 ids (end id last) as bytes, and the text that they decode to."""
        segs = self.segments(text)
        self.learn(set(segs))
        return self.joined(text, segs)

    def encode_all(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """:meth:`encode` of every text, checked; new segments are learned together."""
        rows = [self.segments(t) for t in texts]
        self.learn(set().union(*rows))
        self.check()
        done = [self.joined(text, segs) for text, segs in zip(texts, rows, strict=True)]
        if len(self) > REMEMBERED:
            self.forget()
        return done


def runs(sizes: Iterable[int]) -> Iterator[tuple[int, int]]:
    """(first, rows) of consecutive runs of rows whose sizes come to RUN."""
    at = n = total = 0
    for size in sizes:
        n, total = n + 1, total + size
        if total >= RUN:
            yield at, n
            at, n, total = at + n, 0, 0
    if n:
        yield at, n


@lru_cache(maxsize=2)
def _model(proto: bytes) -> PieceModel:
    return PieceModel(proto)


def _encoder(proto: bytes):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(proto)
        for batch in batches:
            sizes = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist()
            for at, n in runs(sizes):
                part = batch.slice(at, n)
                done = model.encode_all([t or "" for t in part.column("text").to_pylist()])
                ends = np.cumsum([0, *(len(b) // 4 for b, _ in done)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join([b for b, _ in done]), np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("row"), ids, pa.array([t for _, t in done], pa.string())], ["row", "ids", "decoded"])
        model.forget(everything=True)  # an idle worker holds no segments
    return run


def encode_pieces(docs: DataFrame, model_path: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of ``docs`` with ids (array<int>, the end id last) and
    decoded, for every row's whole text.

    Ids equal those of the library's ``encode`` with an end id, decoded its
    ``decode(ids)``; the file at ``model_path`` (a BPE model whose normalizer is
    the identity) is read on the driver. Null texts are empty: the end id
    alone. Repeated rows are encoded alike.
    """
    with open(model_path or public_tokenizers.path(MODEL), "rb") as f:
        proto = f.read()
    names = [f"`{c.replace('`', '``')}`" for c in keep]
    rows = docs.select(F.struct(*names).alias("row"), F.col("text").cast("string").alias("text"))
    schema = T.StructType().add("row", rows.schema["row"].dataType).add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string")
    return rows.mapInArrow(_encoder(proto), schema).select(*[F.col(f"row.{c}") for c in names], "ids", "decoded")


def piece_digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(encode_pieces(table(spark, sf_dir, "documents")))
