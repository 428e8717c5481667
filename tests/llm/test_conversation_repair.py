"""Conversation repair against an exhaustive search."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from stockmill.llm import conversation_repair as cr
from stockmill.llm.common import table

ROWS = "conv_id bigint, turn bigint, role string, text string"
GRAMMAR = re.compile("(s?(ua)+)?")


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        held = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code = zlib.crc32(name.encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        held += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    for held in out.values():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def faults(held):
    seen, out = set(), []
    for _, role, text in held:
        visible = re.findall("[^\x20\x09-\x0d]", text)
        out.append("blank" if not visible else "duplicate" if (role, text) in seen else
                   "" if visible[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def summary(held):
    found = faults(held)
    turns = {t for t, _, _ in held if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(held, held[1:])]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(found.count(k) for k in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs))


def cheapest(held):
    """Least (cost, audit) over all edits with at most two insertions in a row."""
    found, best = faults(held), None
    spots = [list(itertools.chain([""], "ua", ["ua", "au"]))] * (len(held) + 1)
    ways = [(["D"] if f in ("blank", "duplicate") else ["K", "Ru", "Ra", "D"]) for f in found]
    for put in itertools.product(*spots):
        for way in itertools.product(*ways):
            cost, audit, initials, lines = 0, "", "", []
            for k in range(len(held) + 1):
                for x in put[k]:
                    cost, audit, initials = cost + 5, audit + "I", initials + x
                    lines.append(cr.ROLES[x] + ":")
                if k == len(held):
                    break
                letter, (_, role, text) = way[k], held[k]
                audit += letter[0]
                cost += {"K": 0, "R": 1, "D": 2}[letter[0]]
                if letter != "D":
                    cost += 5 * (found[k] == "truncated")
                    new = role if letter == "K" else cr.ROLES[letter[1]]
                    initials += new[:1] or "?"
                    lines.append(f"{new}:{text}")
            if GRAMMAR.fullmatch(initials) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return best


def random_conversations(seed, count, longest):
    rng, rows = random.Random(seed), []
    for conv in range(count):
        for turn in range(rng.randrange(1, longest + 1)):
            rows.append((conv, rng.choice([turn, turn, turn, None, 0, turn * 2]), rng.choice(
                ["system", "user", "user", "assistant", "assistant", "tool", None, ""]),
                rng.choice(["Yes.", "No", "Fine!", "", " \t", None, "Really?\n", "ünï?"])))
    return rows


def test_against_exhaustive_search(spark):
    rows = random_conversations(1, 220, 3)
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    got = cr.repair(cr.damaged(df), copies="copies").collect()
    want = damaged(rows)
    assert len(got) == len(want)
    checked = 0
    for r in got:
        held = want[r.conv_id]
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal) == summary(held)
        if len(held) <= 4:
            checked += 1
            assert (r.cost, r.audit, r.repaired_sha256) == cheapest(held), held
    assert checked > 200


def test_rows_equal_the_digest(spark, sf_dir):
    """Repaired rows follow the grammar and give the digest; all tables' conversations."""
    given = cr.damaged(table(spark, sf_dir, "conversations"))
    repaired = cr.repair(given, copies="copies")
    digests = {r.conv_id: r for r in repaired.collect()}
    texts = {}
    for r in cr.repaired_rows(given, repaired, copies="copies").collect():
        texts.setdefault(r.conv_id, []).append((r.place, r.role, r.text))
    originals = table(spark, sf_dir, "conversations").select("conv_id").distinct().count()
    assert len(digests) == originals
    for conv, r in digests.items():
        lines = sorted(texts.get(conv, []))
        assert [p for p, _, _ in lines] == list(range(len(lines)))
        assert GRAMMAR.fullmatch("".join(role[:1] for _, role, _ in lines))
        body = "\n".join(f"{role}:{text}" for _, role, text in lines)
        assert hashlib.sha256(body.encode()).hexdigest() == r.repaired_sha256


def test_odd_rows(spark):
    """Null keys and values, repeated rows, a long conversation, clashing names, empty tables."""
    rows = [(None, None, None, None), (None, None, None, None), (1, 5, "user", "Hi."),
            (1, 5, "user", "Hi."), (1, -(1 << 62), "assistant", "x" * 100_000 + "."),
            *[(2, i, "ua"[i % 2] * 3, "Go on.") for i in range(6000)]]
    wide = ROWS + ", conv string, copies string, digest string, audit string"
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], wide)
    got = {r.conv_id: r for r in cr.repair(df).collect()}
    assert got[None].blank == 2 and got[None].audit == "DD" and got[None].gaps == 0
    assert got[1].duplicate == 1 and got[1].gaps == 5 + (1 << 62) - 1
    # the second pair of the long conversation repeats the first
    assert (got[2].duplicate, got[2].audit) == (5998, "KK" + "D" * 5998)
    assert cr.repair(df.limit(0)).count() == 0


def test_long_conversation_without_repeats(spark):
    rows = [(7, i, "user" if i % 3 else "assistant", f"Line {i}.") for i in range(9001)]
    r = cr.repair(spark.createDataFrame(rows, ROWS)).collect()[0]
    kept = r.audit.count("K") + r.audit.count("R") + r.audit.count("I")
    assert kept % 2 == 0 and len(r.audit) - r.audit.count("I") == 9001
    cost = {"K": 0, "R": 1, "D": 2, "I": 5}
    assert r.cost == sum(cost[x] for x in r.audit)


@pytest.mark.parametrize("initials, states", [("", True), ("s", False), ("ua", True),
                                              ("sua", True), ("uu", False), ("suaua", True)])
def test_automaton(initials, states):
    stacks, tops = cr.Stacks(), [0]
    for x in initials:
        tops = [t for top in tops for t in stacks._shift(top, x)]
    assert any(stacks._lr.accepts[stacks._nodes[t][0]] for t in tops) == states
