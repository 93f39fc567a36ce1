"""Conversation repair against a plain dynamic program over whole audits."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from cutline.llm import catalog, repair

NEXT = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ROWS = "conv_id long, turn long, role string, text string, key string, at string"


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        out[conv] += []
        if kind == 1:
            text = ""
        elif kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif kind == 4:
            role = "user"
        if kind:
            out[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    return out


def brute(rows):
    result = {}
    for conv, own in damaged(rows).items():
        def place(r):
            return (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).digest())

        own.sort(key=place)
        faults, seen = [], set()
        for _, role, text in own:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
        ways = [(0, "", ()), (10**9, "", ()), (10**9, "", ()), (0, "", ())]

        def filled(ways):
            for _ in range(3):
                ways = [min(ways[q], (3 + ways[NEXT[q][0]][0], "I" + ways[NEXT[q][0]][1], (f"{NEXT[q][1]}:",) + ways[NEXT[q][0]][2]), key=lambda w: w[:2]) for q in range(4)]
            return ways

        ways = filled(ways)
        for (_, role, text), fault in zip(reversed(own), reversed(faults)):
            new = []
            for q in range(4):
                options = [(4 + ways[q][0], "D" + ways[q][1], ways[q][2])]
                if fault in ("", "truncated"):
                    extra = 3 if fault else 0
                    if (q, role[:1]) in KEEP:
                        w = ways[KEEP[q, role[:1]]]
                        options.append((extra + w[0], "K" + w[1], (f"{role}:{text}",) + w[2]))
                    w = ways[NEXT[q][0]]
                    options.append((3 + extra + w[0], "R" + w[1], (f"{NEXT[q][1]}:{text}",) + w[2]))
                new.append(min(options, key=lambda w: w[:2]))
            ways = filled(new)
        cost, audit, lines = ways[0] if own else (0, "", ())
        turns = {t for t, _, _ in own if t is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        result[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"),
            faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return result


def same(got, rows):
    found = {r[0]: tuple(r)[1:] for r in got}
    assert len(found) == len(got)
    want = brute(rows)
    for k in want:
        assert found[k] == want[k], k
    assert set(found) == set(want)


def made(seed, conversations, longest):
    rng = np.random.default_rng(seed)
    texts = ["Ja.", "Nein!", "wie", " ", "", None, "Gut?\n", "mehr Text. ", "x ", "Ende.\t", "é!"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User", "ua"]
    rows = []
    for conv in range(conversations):
        for turn in range(int(rng.integers(1, longest))):
            t = None if rng.random() < 0.03 else int(turn if rng.random() < 0.9 else rng.integers(0, 9))
            role = ["user", "assistant"][turn % 2] if rng.random() < 0.6 else roles[rng.integers(len(roles))]
            text = f"Satz {turn}." if rng.random() < 0.6 else texts[rng.integers(len(texts))]
            rows.append((None if conv == 3 else conv, t, role, text))
    return rows


@pytest.mark.parametrize("bits", [12, 2])
def test_repair_against_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(repair, "SEGMENT_BITS", bits)
    rows = made(bits, 150, 14) + [(9000, t, "user", "gleich.") for t in [1] * 40 + list(range(60))] + [(9001, 5, "a", "x" * 300_000)]
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in rows], ROWS).repartition(5)
    same(repair.repair(frame).collect(), rows)


def test_long_conversation_in_small_segments(spark, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT_BITS", 5)
    rows = [r for r in made(5, 2, 3000)]
    same(repair.repair(spark.createDataFrame([(*r, "x", "x") for r in rows], ROWS)).collect(), rows)


def test_repair_of_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(catalog.queries()["op11_conversation_repair"](spark, sf_dir).collect(), rows)


def test_dropped_and_empty(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = repair.repair(spark.createDataFrame([(gone, 0, "user", "x.", "", "")], ROWS)).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.repair(spark.createDataFrame([], ROWS)).count() == 0
