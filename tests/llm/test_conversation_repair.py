from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from quotaflow.llm import conversation_repair as cr
from quotaflow.llm.common import table
from quotaflow.llm.conversation_repair import best_of, combined, insertions, op13_conversation_repair, repair_report, span_cell, turn_cell
from helpers import SMALL, TURNS, collected


def every_repair(kinds):
    """All edits with up to two insertions at each place, tried one by one."""
    best = None
    gaps = itertools.product(("", "I", "II"), repeat=len(kinds) + 1)
    for gap, edits in itertools.product(list(gaps), list(itertools.product("KRD", repeat=len(kinds)))):
        audit = gap[0] + "".join(e + g for e, g in zip(edits, gap[1:], strict=True))
        cost, roles, at, ok = 0, "", 0, True
        for e in audit:
            kind = kinds[at] if e != "I" else ""
            at += e != "I"
            if e == "D":
                cost += 2
                continue
            ok &= kind != "d"
            cost += {"K": 0, "R": 1, "I": 5}[e] + (5 if kind.isupper() else 0)
            roles += kind.lower() if e == "K" else "a" if roles[-1:] == "u" else "u"
        if ok and re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
            best = (cost, audit)
    return best


def test_grammar_against_all_edits():
    rng = random.Random(1)
    for kinds in ["", *"suaxdSUAX", *["".join(rng.choice("suaxdSUA") for _ in range(rng.choice([2, 3, 3, 4]))) for _ in range(60)]]:
        assert best_of(span_cell(kinds))[0] == every_repair(kinds), kinds


def test_one_cut_a_span_against_all_cuts():
    """The full chart, every span with every cut, has the same cells."""
    rng = random.Random(2)
    for n in (1, 2, 5, 9, 14):
        kinds = "".join(rng.choice("suaxdSUA") for _ in range(n))
        chart = {(i, i + 1): turn_cell(k) for i, k in enumerate(kinds)}
        for size in range(2, n + 1):
            for i in range(n - size + 1):
                cells = [combined(chart[i, m], chart[m, i + size]) for m in range(i + 1, i + size)]
                chart[i, i + size] = tuple(min((c[x] for c in cells if c[x]), default=None) for x in range(16))
        assert chart[0, n] == span_cell(kinds)
    assert combined(insertions(), insertions()) == insertions()


def plain(rows):
    """The contract's result of (conv_id, turn, role, text) rows, turn by turn."""
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        convs[conv] += [(turn is not None, turn or 0, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return [{"conv_id": conv, **plain_one(sorted(turns))} for conv, turns in convs.items()]


def plain_one(rows):
    turns = [t for some, t, _, _ in rows if some]
    count = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    seen, kinds = set(), []
    for _, _, role, text in rows:
        said = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            count[fault] += 1
        kinds.append((role, fault))
    # Least (cost, audit, lines) for each state, turn by turn, with up to two insertions before and behind.
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    full = {"u": "user", "a": "assistant"}

    def inserted(best):
        for _ in range(2):
            for p, (cost, audit, lines) in list(best.items()):
                for x in "ua":
                    if (p, x) in step:
                        new = (cost + 5, audit + "I", lines + (f"{full[x]}:",))
                        best[step[p, x]] = min(best.get(step[p, x], new), new)
        return best

    best = inserted({0: (0, "", ())})
    for (_, _, _, text), (role, fault) in zip(rows, kinds, strict=True):
        nxt = {}
        def offer(q, new):
            nxt[q] = min(nxt.get(q, new), new)
        for p, (cost, audit, lines) in best.items():
            offer(p, (cost + 2, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault else 0
            if (p, role[:1]) in step:
                offer(step[p, role[:1]], (cost + more, audit + "K", lines + (f"{role}:{text}",)))
            for x in "ua":
                if (p, x) in step:
                    offer(step[p, x], (cost + more + 1, audit + "R", lines + (f"{full[x]}:{text}",)))
        best = inserted(nxt)
    cost, audit, lines = min(best[q] for q in (0, 3) if q in best)
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **count,
            "illegal": sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False)),
            "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


def check(spark, rows, df=None):
    got = collected(repair_report(spark.createDataFrame(rows, TURNS) if df is None else df), "conv_id")
    assert got == sorted(plain(rows), key=lambda r: [r["conv_id"] is not None, r["conv_id"] or 0])
    return got


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in table(spark, SMALL, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = collected(op13_conversation_repair(spark, SMALL), "conv_id")
    assert got == sorted(plain(rows), key=lambda r: r["conv_id"])
    assert {c for r in got for c in r["audit"]} >= set("DK")


def random_rows(seed, convs, turns):
    rng = random.Random(seed)
    said = ["Yes.", "No!", "why?  ", "cut off", "", " \n", "same.", "a: b\nc.", "ünï."]
    roles = ["system", "user", "user", "assistant", "assistant", "tool", "", "unknown", None]
    return [(rng.choice([*range(convs), None]), rng.choice([None, *range(turns)]), rng.choice(roles), rng.choice([None, *said, f"{i}.", f"{i}"]))
            for i in range(convs * turns)]


@pytest.mark.parametrize("turns, chars", [(256, 1 << 14), (3, 1 << 14), (256, 9)])
def test_random_rows_in_segments(spark, monkeypatch, turns, chars):
    """Nulls, ties, repeats, other roles; small segments are combined again."""
    monkeypatch.setattr(cr, "TURNS", turns)
    monkeypatch.setattr(cr, "CHARS", chars)
    monkeypatch.setattr(cr, "PIECE", 5)
    rows = random_rows(turns + chars, 25, 9)
    got = check(spark, rows + rows[::3])
    assert {c for r in got for c in r["audit"]} == set("DKR")  # at these costs an insertion never pays


def test_one_long_conversation_over_many_tasks(spark):
    rng = random.Random(5)
    rows = [(7, i, rng.choice(["user", "assistant", "assistant"]), f"turn {i % 900} " * 10 + rng.choice([".", ".", "?", ""])) for i in range(4000)]
    rows += [(None, None, "user", "the same.")] * 3000 + [(8, 3, "system", "x" * 300_000 + ".")]
    check(spark, rows)


def test_dropped_conversations_empty_tables_and_further_columns(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hi."), (None, 5, "user", "Hi."), (None, None, None, None)]
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS conv", "2 AS copies", "'z' AS kind", "3 AS part", "4 AS blank")
    got = check(spark, rows, df)
    assert {"gaps": 0, "cost": 0, "audit": "", "illegal": 0}.items() <= next(r for r in got if r["conv_id"] == gone).items()
    assert repair_report(df.limit(0)).count() == 0
