"""Conversation repair against all edit sequences of small conversations and against a plain table of whole strings."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from conftest_llm import rows

from fundlens.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string"
FULL = re.compile(r"[^\x20\x09-\x0D]")


def marked(turns):
    """(role, text, fault) of the rows in order."""
    seen, out = set(), []
    for role, text in turns:
        fault = "blank" if not FULL.search(text) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(" \t\n\x0b\x0c\r")[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def table(turns):
    """Cheapest (cost, edits) by states, with whole strings."""
    best = {0: (0, "")}

    def put_in(b):
        b = dict(b)
        for _ in range(2):
            for s, t in ((0, 2), (1, 2), (3, 2), (2, 3)):
                if s in b:
                    b[t] = min(b.get(t, (10**9, "")), (b[s][0] + 5, b[s][1] + "I"))
        return b

    for role, _, fault in marked(turns):
        old, best = put_in(best), {}

        def offer(s, cost, edits):
            best[s] = min(best.get(s, (10**9, "")), (cost, edits))

        for s, (cost, edits) in old.items():
            offer(s, cost + 2, edits + "D")
            if fault in ("blank", "duplicate"):
                continue
            extra = 5 * (fault == "truncated")
            for t, before in ((1, (0,)), (2, (0, 1, 3)), (3, (2,))):
                if s in before:
                    if role[:1] == " sua"[t]:
                        offer(t, cost + extra, edits + "K")
                    elif t > 1:
                        offer(t, cost + extra + 1, edits + "R")
    best = put_in(best)
    return min(best[s] for s in (0, 3) if s in best)


def all_edits(turns):
    """The same by trying all edits, with at most two turns put in at a place."""
    found = []
    slots = [[""] + ["I" + x for x in ("", "I")]] * (len(turns) + 1)
    for edits in itertools.product("KRD", repeat=len(turns)):
        if any(f in ("blank", "duplicate") and e != "D" for e, (_, _, f) in zip(edits, marked(turns), strict=True)):
            continue
        for put in itertools.product(*slots):
            audit = "".join(p + e for p, e in itertools.zip_longest(put, edits, fillvalue=""))
            cost = 5 * audit.count("I") + audit.count("R") + 2 * audit.count("D") + 5 * sum(f == "truncated" and e != "D" for e, (_, _, f) in zip(edits, marked(turns), strict=True))
            options = [""]
            at = 0
            for e in audit:
                new = {"K": [turns[at][0][:1] or "?"] if e == "K" else [], "R": ["u", "a"], "I": ["u", "a"], "D": [""]}[e]
                options = [o + n for o in options for n in new]
                at += e != "I"
            if any(re.fullmatch("(s?(ua)+)?", o) for o in options):
                found.append((cost, audit))
    return min(found)


def damage(turns):
    for conv, turn, role, text in turns:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            yield from [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)


def expected(turns, ids):
    by_conv = defaultdict(list)
    for conv, turn, role, text in turns:
        by_conv[conv].append((turn is not None, turn or 0, role, text))
    out = []
    for conv in ids:
        got = sorted(by_conv[conv])
        plain = [(r, t) for _, _, r, t in got]
        faults = [f for _, _, f in marked(plain)]
        numbers = [t for k, t, _, _ in got if k]
        cost, audit = table(plain)
        kept, at, state = [], 0, ""
        for e in audit:
            if e != "D":
                state = plain[at][0][:1] if e == "K" else "a" if state == "u" else "u"
                kept.append(plain[at] if e == "K" else ({"u": "user", "a": "assistant"}[state], plain[at][1] if e == "R" else ""))
            at += e != "I"
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in kept))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(plain, plain[1:]))
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()), key=str)


def random_turns(rng, n, texts="abc"):
    return [(rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice([f"{c}{e}" for c in texts for e in ".. "] + ["", " \t"])) for _ in range(n)]


def edits(turns):
    segment = cv.Segment(True)
    for role, text, n, fresh in turns:
        segment.add(0, role, text, n, fresh)
    whole, *_, costs, audits, kept, _ = segment.record(True)
    return costs[0], audits[0], kept


def test_audit_against_all_edits():
    rng = random.Random(2)
    for _ in range(60):
        turns = random_turns(rng, rng.randrange(4))
        cost, audit, _ = edits([(r, t, 1, f != "duplicate") for r, t, f in marked(turns)])
        assert (cost, audit) == table(turns) == all_edits(turns)


def test_audit_against_whole_strings():
    rng = random.Random(4)
    for _ in range(300):
        turns = random_turns(rng, rng.randrange(40), "abcdefghij")
        assert edits([(r, t, 1, f != "duplicate") for r, t, f in marked(turns)])[:2] == table(turns)


def test_collisions_change_nothing(monkeypatch):
    monkeypatch.setattr(cv, "_PRIME", 3)
    test_audit_against_whole_strings()


def test_long_common_prefixes():
    audit = cv.Audit()
    a = b = 0
    for i in range(1000):
        a = b = audit.extend(a, "KD"[i % 2])
    x, y = audit.extend(a, "D"), audit.extend(b, "K")
    for _ in range(500):
        x, y = audit.extend(x, "R"), audit.extend(y, "D")
    assert audit.less(x, y) and not audit.less(y, x) and not audit.less(x, x)


@pytest.mark.parametrize("segment_rows", [1, 3, 1024])
def test_against_plain_repair(spark, segment_rows):
    """Long conversations in segments, nulls, a hot one, repeats, one without rows left."""
    rng = random.Random(9)
    turns = [(c, t, *random_turns(rng, 1, "abcdefghijklmnopqrstuvwxyz")[0]) for c in range(25) for t in range(rng.randrange(1, 14))]
    turns += [(99, t, rng.choice(["user", "assistant"]), f"{t % 150}.") for t in range(400)]
    turns += [(None, 3, "user", "Hi."), (None, None, None, None), (None, 4, "assistant", "Oh!"), (50, None, "user", "x."), (50, None, "user", "x."), (50, 7, "assistant", "y"), (51, 1, "user", None), (52, 2, None, "z.")]
    turns += [(53, 5, "user", "same.")] * 40 + [(53, 6, "assistant", "same.")] * 3
    turns += [(next(c for c in range(100, 999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0), 0, "user", "gone.")]
    df = spark.createDataFrame(turns, SCHEMA).repartition(4)
    got = found(cv.audited(cv.damaged(df), df.select("conv_id"), segment_rows))
    assert got == expected(list(damage(turns)), {t[0] for t in turns})


def test_turns_of_the_repaired_conversation(spark):
    rng = random.Random(1)
    turns = [(c, t, *random_turns(rng, 1, "abcdefgh")[0]) for c in range(6) for t in range(30)]
    df = spark.createDataFrame(turns, SCHEMA)
    texts = defaultdict(list)
    for r in sorted(rows(cv.repaired_turns(df, 7)), key=lambda r: (r["conv_id"], r["position"])):
        assert r["position"] == len(texts[r["conv_id"]])
        texts[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    hashes = {r[0]: r[-1] for r in found(cv.audited(df))}
    assert {c: hashlib.sha256("\n".join(t).encode()).hexdigest() for c, t in texts.items()} == {c: h for c, h in hashes.items() if c in texts}


def test_empty_and_clashing_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert found(cv.audited(cv.damaged(empty), empty.select("conv_id"))) == []
    some = spark.createDataFrame([(1, 0, "user", "A.", 5, 6, 7), (1, 1, "assistant", "B.", 5, 6, 7)], SCHEMA + ", n long, h long, rows long")
    assert [r[-2] for r in found(cv.audited(some))] == ["KK"]
