"""Repaired conversations against a search over all edits, in plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marquee.llm import conversations
from marquee.llm.common import prepare
from marquee.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
SOLID, ENDED = re.compile(r"[^\x20\x09-\x0D]"), re.compile(r"[.!?][\x20\x09-\x0D]*\Z")
FITS = re.compile("(s?(ua)+)?")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """[(turn, role, text)] to gaps, faults, cost, audit and repaired rows: dynamic programming
    over (rows done, initials so far as a state of the pattern), with whole audits as weights."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, faults, kinds = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
    for _, role, text in rows:
        fault = None
        if not SOLID.search(text):
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        elif not ENDED.search(text):
            fault = "truncated"
        seen.add((role, text))
        kinds.append(fault)
        if fault:
            faults[fault] += 1
    initials = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    # A state is what matters of the initials so far: none, "s", or the last of u and a.
    best = {"": (0, "", [])}

    def add(table, state, new, weight, edit, made):
        after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((state, new))
        if after is not None:
            cost, audit, out = table[state] if not isinstance(state, tuple) else state
            offer = (cost + weight, audit + edit, [*out, made])
            return after, offer
        return None

    def inserts(table):
        while True:
            changed = False
            for state in list(table):
                for new, role in (("u", "user"), ("a", "assistant")):
                    found = add(table, state, new, 3, "I", (role, ""))
                    if found and (found[0] not in table or found[1][:2] < table[found[0]][:2]):
                        table[found[0]] = found[1]
                        changed = True
            if not changed:
                return table

    best = inserts(best)
    for (_, role, text), kind in zip(rows, kinds):
        after = {}
        for state, (cost, audit, out) in best.items():
            offers = [(state, (cost + 4, audit + "D", out))]
            if kind not in ("blank", "duplicate"):
                extra = 3 if kind == "truncated" else 0
                offers.append(add(best, state, role[:1], extra, "K", (role, text)))
                offers += [add(best, state, r[0], 3 + extra, "R", (r, text)) for r in ("user", "assistant")]
            for offer in filter(None, offers):
                if offer[0] not in after or offer[1][:2] < after[offer[0]][:2]:
                    after[offer[0]] = offer[1]
        best = inserts(after)
    cost, audit, out = min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])
    assert FITS.fullmatch("".join(r[:1] for r, _ in out))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, out


def digest(out):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def by_conversation(rows):
    table = defaultdict(list)
    for conv, *rest in rows:
        table[conv].append(tuple(rest))
    return table


def every_edit(rows):
    """Cheapest and least audit by trying all strings of edits, for a few rows."""
    best = None
    agenda = [(0, "", 0, "")]
    limit = 4 * len(rows) + 1
    while agenda:
        cost, audit, place, made = agenda.pop()
        if cost >= limit or (best and cost > best[0]):
            continue
        if place == len(rows) and FITS.fullmatch(made) and (best is None or (cost, audit) < best):
            best = (cost, audit)
        if audit.count("I") <= len(rows):
            agenda += [(cost + 3, audit + "I", place, made + x) for x in "ua"]
        if place < len(rows):
            letter, must, extra = rows[place]
            agenda.append((cost + 4, audit + "D", place + 1, made))
            if not must:
                agenda.append((cost + extra, audit + "K", place + 1, made + letter))
                agenda += [(cost + 3 + extra, audit + "R", place + 1, made + x) for x in "ua"]
    return best


def test_agenda_finds_the_least_of_all_edits():
    draw = random.Random(5)
    for _ in range(60):
        rows = [(draw.choice("suao"), draw.random() < 0.2, draw.choice([0, 0, 3])) for _ in range(draw.randrange(5))]
        tokens = ["x1" if must else (a.upper() if extra else a) for a, must, extra in rows]
        final = conversations.lightest(conversations.row_edges(tokens), conversations.START)
        found = min(final[len(tokens), q][:2] for q in conversations.ACCEPTED if (len(tokens), q) in final)
        assert found == every_edit(rows)


def check(spark, rows):
    df = prepare(spark).createDataFrame(rows, SCHEMA).withColumn("conv", F.lit("x")).withColumn("print", F.lit(1))
    summary, turns = conversations.repair(df)
    prints = {r.key: r.sha256 for r in conversations.digests(turns).collect()}
    found = {r.conv_id: tuple(r)[1:] for r in summary.collect()}
    filled = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    table = by_conversation(filled)
    assert found.keys() == table.keys()
    made = defaultdict(list)
    for r in turns.collect():
        made[r.conv_id].append((r.block, r.seq, r.role, r.text))
    for conv, part in table.items():
        *expected, out = plain_repair(part)
        assert found[conv] == tuple(expected), conv
        assert [r[2:] for r in sorted(made[conv])] == out, conv
        key = "" if conv is None else f"={conv}"
        assert prints.get(key, digest([])) == digest(out), conv


def test_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    table = by_conversation(plain_damage(rows))
    expected = {}
    for conv in {r[0] for r in rows}:
        *counts, out = plain_repair(table[conv])
        expected[conv] = (*counts, digest(out))
    assert {r.conv_id: tuple(r)[1:] for r in QUERIES["op12_conversations"](spark, SMALL).collect()} == expected


@pytest.mark.parametrize("bits", [(6, 5), (1, 1)])
def test_random_conversations(spark, monkeypatch, bits):
    monkeypatch.setattr(conversations, "BLOCK_BITS", bits[0])
    monkeypatch.setattr(conversations, "FAN_BITS", bits[1])
    draw = random.Random(7)
    texts = ["One.", "One.", "Two", " \t", "", "Three! \n", "Four?", "five", "Six.", None]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "Sys", "ux"]
    rows = []
    for conv in range(40):
        for turn in range(draw.randrange(9)):
            text = draw.choice(texts)
            text = f"{turn} {text}" if text and draw.random() < 0.7 else text
            rows.append((conv, draw.choice([turn, turn, turn + 3, None]), draw.choice(roles), text))
    for turn in range(500):  # one long conversation
        rows.append((None, turn // 2, roles[draw.randrange(5)], f"{draw.randrange(300)}{draw.choice('.. !x')}"))
    rows += [(99, 5, "user", "the same.")] * 150 + [(99, 6, "assistant", "and then.")] * 3
    check(spark, rows)


def test_empty_and_long(spark):
    df = prepare(spark).createDataFrame([], SCHEMA)
    summary, turns = conversations.repair(df)
    assert summary.collect() == [] and turns.collect() == [] and conversations.digests(turns).collect() == []
    check(spark, [(1, 0, "user", "a long text " * 30_000 + "."), (1, 1, "assistant", "b" * 200_000), (2, None, None, None)])


def test_damage(spark):
    rows = [(c, t, r, x) for c in (1, 2, None) for t in (*range(60), None) for r, x in (("user", "A! b? c."), (None, None))]
    df = prepare(spark).createDataFrame(rows, SCHEMA)
    found = sorted((tuple(r) for r in conversations.damage(df).collect()), key=repr)
    assert found == sorted(plain_damage(rows), key=repr)
