"""Repair of conversation structure by weighted interval parsing.

A repaired conversation's roles read ``(s?(ua)+)?``: nothing, or an optional system turn
and then user and assistant in turn. The repair grammar in Chomsky normal form has a
nonterminal for every pair of states of that pattern; ``[p q]`` covers a span of turns
whose edits lead from p to q:

    [p q] -> [p r] [r q]          a span and the next one
    [p q] -> turn                 keep, rerole or delete it
    [p q] -> empty                inserted turns, closed over all their numbers

A span's cell holds for each nonterminal the least (cost, audit), audits compared as
strings. Edits of one span always have one letter a turn besides insertions, and each
insertion costs: of two audits of one cost neither begins the other, so that least parts
make the least whole. Whatever the rules of a derivation, it can be cut between any two
turns; so spans are combined bottom-up by length, each with its neighbour, and every
span needs one cut.

Conversations are sorted over all tasks and cut into segments of bounded size; a
segment's cells are parsed where it lies. Only cells meet per conversation, the texts
come back by segment, and the repaired text is hashed as a stream: nothing but the
audit itself (some 32 bytes a turn while cells are combined) grows in a task with the
length of a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidy, written

#: States: nothing yet, after system, after user, after assistant; the state after a role, and the ends.
STATES = 4
AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SAID, CLOSED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
#: Turns and code points of a segment, pieces of a repaired text that go to its hash, rows taken at a time.
TURNS, CHARS, PIECE, SLICE = 256, 1 << 14, 1 << 14, 256

Cell = tuple  # of (cost, audit) or None, for [p q] at p * STATES + q


def combined(a: Cell, b: Cell) -> Cell:
    """The cell of two neighbouring spans."""
    out = []
    for p in range(STATES):
        for q in range(STATES):
            best = None
            for r in range(STATES):
                x, y = a[p * STATES + r], b[r * STATES + q]
                if x and y and (best is None or x[0] + y[0] <= best[0]):
                    both = (x[0] + y[0], x[1] + y[1])
                    best = both if best is None else min(best, both)
            out.append(best)
    return tuple(out)


def _cell(rules: list[tuple[int, int, int, str]]) -> Cell:
    """The least of (p, q, cost, audit) for each nonterminal."""
    out: list = [None] * STATES * STATES
    for p, q, cost, audit in rules:
        at = p * STATES + q
        out[at] = min(filter(None, (out[at], (cost, audit))))
    return tuple(out)


def _turns(p: int) -> Iterator[int]:
    return (q for (before, role), q in AFTER.items() if before == p and role in "ua")


@lru_cache(maxsize=1)
def insertions() -> Cell:
    """The empty span: any number of inserted turns."""
    cell = _cell([(p, p, 0, "") for p in range(STATES)] + [(p, q, INSERT, "I") for p in range(STATES) for q in _turns(p)])
    while (longer := combined(cell, cell)) != cell:
        cell = longer
    return cell


@lru_cache(maxsize=32)
def turn_cell(kind: str) -> Cell:
    """One turn: d must go, else its role's initial (x for others), a capital if it is truncated."""
    rules = [(p, p, DELETE, "D") for p in range(STATES)]
    if kind != "d":
        more = TRUNCATED if kind.isupper() else 0
        for p in range(STATES):
            if q := AFTER.get((p, kind.lower())):
                rules.append((p, q, more, "K"))
            rules += [(p, q, more + REROLE, "R") for q in _turns(p)]
    return combined(combined(insertions(), _cell(rules)), insertions())


@lru_cache(maxsize=1 << 12)
def span_cell(kinds: str) -> Cell:
    """The cell of a span of turns, combined bottom-up by length; equal short spans are parsed once."""
    if not kinds:
        return insertions()
    cells = [turn_cell(k) for k in kinds]
    while len(cells) > 1:
        cells = [combined(*cells[i:i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


def best_of(cell: Cell) -> tuple[tuple[int, str], int]:
    """The least (cost, audit) of a whole conversation and the state it ends in."""
    return min((cell[q], q) for q in ENDS if cell[q])


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, conv, turn, role, text, copies) of (conv_id, turn, role, text) rows: by the check sum of
    ``conv_id:turn`` a row is dropped, emptied, loses its closing marks, is repeated or becomes the user's.
    Nulls read as one space; equal rows are one with their number. ``conv`` is the id as text, empty if null."""
    one = F.lit(" ")
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), one).alias("role"), F.coalesce(F.col("text").cast("string"), one).alias("text"))
    fault = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), one), F.lit(":"), F.coalesce(F.col("turn").cast("string"), one))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return (rows.withColumn("fault", fault).where("fault <> 0")
            .select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                    F.when(F.col("fault") == 3, 2).otherwise(1).alias("copies"))
            .groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
            .withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(""))))


def marked(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, conv, turn, role, text, copies) with their faults: blank, repeated (all copies), truncated
    (the first copy), and ``kind``, that of the first copy in the grammar."""
    place = F.struct(F.col("turn").isNotNull().alias("some"), "turn")  # nulls first
    said = rows.withColumn("blank", ~F.col("text").rlike(SAID)).withColumn("text_md5", F.md5("text")).withColumn("place", place)
    first = said.where("NOT blank").groupBy("conv", "role", "text_md5").agg(F.min("place").alias("first"))
    initial = F.substring("role", 1, 1)
    found = (said.join(first, ["conv", "role", "text_md5"], "left")
             .withColumn("again", ~F.col("blank") & ~F.col("place").eqNullSafe(F.col("first")))
             .withColumn("truncated", ~F.col("blank") & ~F.col("again") & ~F.col("text").rlike(CLOSED)))
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    return found.select(
        "conv", "turn", "role", "text", "copies", "blank", "truncated",
        (F.when(F.col("blank"), 0).otherwise(F.col("copies") - F.when(F.col("again"), 0).otherwise(1))).alias("repeated"),
        F.when(F.col("blank") | F.col("again"), "d").when(F.col("truncated"), F.upper(letter)).otherwise(letter).alias("kind"))


SEGMENT = ("conv string, part int, number long, illegal long, first string, last string, kinds string, "
           "costs array<long>, audits array<string>, roles array<string>, texts array<string>")


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns to segments: their cells, and the texts of turns that may stay."""
    part, number, out, size = TaskContext.get().partitionId(), 0, [], 0
    conv, kinds, initials, roles, texts, chars = None, [], [], [], [], 0

    def segment() -> dict:
        cell = span_cell("".join(kinds))
        return {"conv": conv, "part": part, "number": number, "first": initials[0], "last": initials[-1],
                "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
                "kinds": "".join(kinds), "costs": [c and c[0] for c in cell], "audits": [c and c[1] for c in cell], "roles": roles, "texts": texts}

    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            for r in batch.slice(at, SLICE).to_pylist():
                for copy in range(r["copies"]):
                    if kinds and (r["conv"] != conv or len(kinds) >= TURNS or chars >= CHARS):
                        out.append(segment())
                        number, size = number + 1, size + chars
                        kinds, initials, roles, texts, chars = [], [], [], [], 0
                        if len(out) >= TURNS or size >= 64 * CHARS:
                            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
                            out, size = [], 0
                    conv = r["conv"]
                    kind = r["kind"] if not copy else "d"
                    kinds.append(kind)
                    initials.append(r["role"][:1])
                    stays = kind != "d"
                    roles.append(r["role"] if stays else None)
                    texts.append(r["text"] if stays else None)
                    chars += len(r["text"]) if stays else 0
    if kinds:
        out.append(segment())
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_ARROW)


_LIST = pa.list_(pa.string())
_ARROW = pa.schema([("conv", pa.string()), ("part", pa.int32()), ("number", pa.int64()), ("illegal", pa.int64()), ("first", pa.string()),
                    ("last", pa.string()), ("kinds", pa.string()), ("costs", pa.list_(pa.int64())), ("audits", _LIST), ("roles", _LIST), ("texts", _LIST)])


def way_through(cells: list[Cell]) -> tuple[tuple[int, str], list[int]]:
    """The least (cost, audit) of neighbouring segments' cells, combined bottom-up, and the nonterminal of each."""
    levels = [cells]
    while len(levels[-1]) > 1:
        level = levels[-1]
        levels.append([combined(*level[i:i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)])
    best, end = best_of(levels[-1][0])
    ways = [(0, end)]
    for below in reversed(levels[:-1]):
        halves = []
        for i, (p, q) in enumerate(ways):
            if 2 * i + 1 == len(below):
                halves.append((p, q))
                continue
            a, b = below[2 * i:2 * i + 2]
            r = min((a[p * STATES + r][0] + b[r * STATES + q][0], a[p * STATES + r][1] + b[r * STATES + q][1], r)
                    for r in range(STATES) if a[p * STATES + r] and b[r * STATES + q])[2]
            halves += [(p, r), (r, q)]
        ways = halves
    return best, [p * STATES + q for p, q in ways]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments sorted by conversation: a row each with its nonterminal, the first one with the conversation's result."""
    schema = pa.schema([("conv", pa.string()), ("part", pa.int32()), ("number", pa.int64()), ("way", pa.int32()),
                        ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])
    held: list[dict] = []

    def ended() -> list[dict]:
        (cost, audit), ways = way_through([r["cell"] for r in held])
        illegal = sum(r["illegal"] for r in held) + sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(held, held[1:], strict=False))
        out = [{"conv": r["conv"], "part": r["part"], "number": r["number"], "way": w} for r, w in zip(held, ways, strict=True)]
        out[0] |= {"illegal": illegal, "cost": cost, "audit": audit}
        held.clear()
        return out

    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            out = []
            for r in batch.slice(start, SLICE).to_pylist():
                if held and held[0]["conv"] != r["conv"]:
                    out += ended()
                r["cell"] = tuple(None if a is None else (c, a) for c, a in zip(r.pop("costs"), r.pop("audits"), strict=True))
                held.append(r)
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    if held:
        yield pa.RecordBatch.from_pylist(ended(), schema=schema)


def repaired_turns(audit: str, state: int, roles: list, texts: list) -> Iterator[tuple[str, str]]:
    """The (role, text) turns that an audit leaves of a segment entered in ``state``."""
    at = 0
    for edit in audit:
        role, text = (roles[at], texts[at]) if edit != "I" else (None, "")
        at += edit != "I"
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if state == 2 else "user"
        state = AFTER[state, role[0]]
        yield role, text


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each segment's repaired lines in pieces."""
    schema = pa.schema([("conv", pa.string()), ("part", pa.int32()), ("number", pa.int64()), ("at", pa.int64()), ("piece", pa.string())])
    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            out = []
            for r in batch.slice(start, 64).to_pylist():
                lines = "".join(f"{role}:{text}\n" for role, text in repaired_turns(r["audit"], r["way"] // STATES, r["roles"], r["texts"]))
                out += [{"conv": r["conv"], "part": r["part"], "number": r["number"], "at": i, "piece": lines[i:i + PIECE]} for i in range(0, len(lines), PIECE)]
            yield pa.RecordBatch.from_pylist(out, schema=schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to the digest of each conversation, without the last line's end."""
    schema = pa.schema([("conv", pa.string()), ("repaired_sha256", pa.string())])
    conv, digest, held, out = None, None, "", []
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            for r in batch.slice(start, SLICE).to_pylist():
                if r["conv"] != conv:
                    if digest:
                        out.append({"conv": conv, "repaired_sha256": digest.hexdigest()})
                    conv, digest, held = r["conv"], hashlib.sha256(), ""
                piece = held + r["piece"]
                digest.update(piece[:-1].encode())
                held = piece[-1]  # a line's end counts only if another line follows
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
    if digest:
        yield pa.RecordBatch.from_pylist([{"conv": conv, "repaired_sha256": digest.hexdigest()}], schema=schema)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, lines) of ``rows`` (conv, turn, role, text, copies, kind): (conv, illegal, cost, audit), and
    the repaired lines ``role:text`` as (conv, part, number, at, piece), pieces in the order of these columns."""
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text"]
    segments = written(rows.select("conv", "turn", "role", "text", "copies", "kind").repartitionByRange(*order).sortWithinPartitions(*order)
                       .mapInArrow(tidy(_segments), SEGMENT), "repair-segments")
    whole = written(segments.select("conv", "part", "number", "illegal", "first", "last", "costs", "audits")
                    .repartition("conv").sortWithinPartitions("conv", "part", "number").mapInArrow(
        tidy(_whole), "conv string, part int, number long, way int, illegal long, cost long, audit string"), "repair-ways")
    taken = (segments.join(whole.select("conv", "part", "number", "way"), ["conv", "part", "number"])
             .select("conv", "part", "number", "way", F.get("audits", F.col("way")).alias("audit"), "roles", "texts"))
    lines = taken.mapInArrow(tidy(_pieces), "conv string, part int, number long, at long, piece string")
    return whole.where("audit IS NOT NULL").select("conv", "illegal", "cost", "audit"), lines


def repair_report(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for every conv_id of
    ``conversations`` (conv_id, turn, role, text) after the damage of :func:`damaged`.

    Rows of a null conv_id are one conversation. Turns go by number (null first), then role and text, so that
    equal rows lie together. Only ``s``, ``u`` and ``a`` at a role's beginning can be kept; an empty role has
    no initial. Texts and conversations of any length are taken whole, empty tables give none and further
    columns are ignored.
    """
    rows = written(marked(damaged(conversations)), "repair-turns")
    counts = (rows.groupBy("conv", "turn").agg(F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
                                              F.sum("repeated").alias("duplicate"), F.sum(F.col("truncated").cast("long")).alias("truncated"))
              .groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"),
                                   *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")]))
    results, lines = repair(rows)
    digests = (lines.repartition("conv").sortWithinPartitions("conv", "part", "number", "at")
               .mapInArrow(tidy(_digests), "conv string, repaired_sha256 string"))
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return (every.join(counts, "conv", "left").join(results, "conv", "left").join(digests, "conv", "left")
            .select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(table(spark, sf_dir, "conversations"))
