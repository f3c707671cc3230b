"""Conversation repair against a plain search over all edits, and its edge cases."""

import hashlib
import itertools
import random
import re
import zlib
from pathlib import Path

import duckdb
import pytest

from annulus.llm import conversations
from annulus.llm.conversations import damage, repair_conversations
from annulus.llm.queries import op12_conversation_repair
from annulus.llm.ranks import joined_sha256
from annulus.llm.storage import Store

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"
GRAMMAR = re.compile("(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for row in rows:
        core = row[1].strip(SPACE)
        out.append("blank" if not core else "duplicate" if row in seen else "truncated" if core[-1] not in ".!?" else None)
        seen.add(row)
    return out


def search(rows):
    """Least (cost, audit, turns), with every string of edits as the state's value."""
    found = {"": (0, "", ())}  # by the whole sequence of initials so far

    def inserted(states):
        out = dict(states)
        for initials, (cost, audit, turns) in list(out.items()):
            for more in ("u", "a", "ua", "au"):
                new = (cost + 5 * len(more), audit + "I" * len(more), turns + tuple(({"u": "user", "a": "assistant"}[m], "") for m in more))
                out[initials + more] = min(out.get(initials + more, new), new)
        return {k: v for k, v in out.items() if re.fullmatch("s?(ua)*u?", k)}

    for row, fault in zip(rows, faults(rows)):
        after = {}
        for initials, (cost, audit, turns) in inserted(found).items():
            options = [(initials, cost + 2, audit + "D", turns)]
            if fault not in ("blank", "duplicate"):
                stays = 5 * (fault == "truncated")
                options += [(initials + row[0][:1], cost + stays, audit + "K", (*turns, row))] * (row[0][:1] in ("s", "u", "a"))
                options += [(initials + r[0], cost + stays + 1, audit + "R", (*turns, (r, row[1]))) for r in ("user", "assistant")]
            for key, *value in options:
                if re.fullmatch("s?(ua)*u?", key):
                    after[key] = min(after.get(key, tuple(value)), tuple(value))
        found = after
    return min(v for k, v in inserted(found).items() if GRAMMAR.fullmatch(k))


def plain(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, turns) of rows (turn, role, text) in order."""
    turns, of = [t for t, *_ in rows if t is not None], [(r, x) for _, r, x in rows]
    marks = faults(of)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(of, of[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *(marks.count(x) for x in ("blank", "duplicate", "truncated")), illegal, *search(of)


def result(repaired):
    turns = {}
    for r in sorted(repaired.turns.collect(), key=lambda r: r.place):
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    return {r.conv_id: (*tuple(r)[1:], tuple(turns.get(r.conv_id, ()))) for r in repaired.audits.collect()}


def invented(seed, conversations=40, longest=9):
    rng = random.Random(seed)
    out = []
    for c in range(conversations):
        for t in range(rng.randrange(1, longest)):
            text = rng.choice(("Yes.", "No", "Why?", "", " \t", "Well. ", "Go!\n", f"Said {rng.randrange(99)}."))
            out.append((c, t + rng.randrange(2) * (t > 3), rng.choice(("user", "assistant", "assistant", "user", "system", "tool", "", "uncle")), text))
    return out


def in_order(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t, " " if r is None else r, " " if x is None else x))
    digest = lambda r, x: hashlib.sha256(f"{len(r.encode())}:{r}:{x}".encode()).hexdigest()
    return {c: sorted(v, key=lambda y: (y[0] is not None, y[0] or 0, y[1].encode(), digest(*y[1:]))) for c, v in by.items()}


@pytest.mark.parametrize("seed, segment", [(1, 256), (2, 1), (3, 3)])
def test_equals_search_over_all_edits(spark, seed, segment):
    rows = invented(seed)
    got = result(repair_conversations(spark.createDataFrame(rows, SCHEMA), segment_turns=segment, batch_turns=7))
    assert got == {c: plain(v) for c, v in in_order(rows).items()}


def test_moves_are_the_least_of_all_orders():
    """Every string of up to three turns, by class and fault, priced one edit at a time."""
    for roles in itertools.product(("system", "user", "assistant", "tool"), repeat=3):
        for texts in itertools.product(("Ok 1.", "", "Cut"), ("Ok 2.", "", "Cut 2"), ("Ok 3.", "Cut 3")):
            rows = list(zip(roles, texts))
            best = {0: (0, "")}
            table = {}
            for state, kind, to, cost, edits in conversations._moves():
                table.setdefault((state, kind), []).append((to, cost, edits))
            for (role, _), fault in zip(rows, faults(rows)):
                kind = 3 * ("sua".find(role[0]) % 4) + (0 if fault is None else 1 if fault == "truncated" else 2)
                after = {}
                for state, (cost, audit) in best.items():
                    for to, more, edits in table[state, kind]:
                        after[to] = min(after.get(to, (99, "")), (cost + more, audit + edits))
                best = after
            ends = [(c + 5 * len(e), a + e) for s, (c, a) in best.items() for to, e in conversations._insertions(s).items() if to in (0, 3)]
            assert min(ends) == search(rows)[:2]


def test_query_equals_plain_version(spark):
    data = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{data}/conversations.parquet' ORDER BY ALL").fetchall()
    damaged = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{c}:{t}".encode()) % 20
        row = (c, t, "user" if kind == 4 else r, "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x)
        damaged += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    want = {c: (0, 0, 0, 0, 0, 0, "", ()) for c, *_ in rows} | {c: plain(v) for c, v in in_order(damaged).items()}
    got = {r.conv_id: tuple(r)[1:] for r in op12_conversation_repair(spark, data).collect()}
    assert got == {c: (*v[:-1], hashlib.sha256("\n".join(f"{r}:{x}" for r, x in v[-1]).encode()).hexdigest()) for c, v in want.items()}


def test_damage_by_hash(spark):
    rows = [(c, t, "assistant", f"A. B! {c}?") for c in range(40) for t in range(3)] + [(None, None, None, None), (7, None, None, "x.")]
    got = sorted(map(str, (tuple(r) for r in damage(spark.createDataFrame(rows, SCHEMA)).collect())))
    want = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        row = (c, t, "user" if kind == 4 else r, "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x)
        want += [str(row)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert got == sorted(want)


def test_edge_cases(spark):
    long = [(9, t, ("user", "assistant")[t % 2], f"Turn {t}." + "x" * 200_000 * (t == 5) + ".") for t in range(700)]
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (3, None, "user", "A."), (3, None, "assistant", "B."), (3, None, "user", "A."), (4, 5, "system", "Only."), *long]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], SCHEMA + ", place long, digest string")
    repaired = repair_conversations(df, segment_turns=64)
    got = result(repaired)
    assert got == {c: plain(v) if c != 9 else (0, 0, 0, 0, 0, 0, "K" * 700, tuple((r, x) for _, _, r, x in long)) for c, v in in_order(rows).items()}
    assert got[None][0] == 0 and got[3][0] == 0
    digest = {r.conv_id: r.sha256 for r in joined_sha256(repaired.turns, "conv_id", "place", "text", "|").collect()}
    assert digest[9] == hashlib.sha256("|".join(x[3] for x in long).encode()).hexdigest()
    none = repair_conversations(spark.createDataFrame([], SCHEMA), Store(spark, "none"))
    assert none.audits.count() == 0 and none.turns.count() == 0
