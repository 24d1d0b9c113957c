"""Repair of conversation structure as a lightest derivation, found with Knuth's agenda.

A conversation is to have the role initials ``(s?(ua)+)?``, an automaton of four states. An item
says that the first rows of a conversation have been edited so that the automaton is in a state;
a deduction extends an item by one edit. The weight of a derivation is its pair (cost, audit), the
audit being its edits' initials in order. Extending by an edit is a superior function: the pair
never gets less, and it keeps the order of two derivations of the same item, since two of equal
cost over the same rows are never prefixes of each other. So items leave the agenda with their
lightest derivation, lightest first, until the goal is final.

Conversations may be of any length. Rows are numbered in one order of all conversations, and a
block holds a bounded number of them; a block's items are derived from each state it may be
entered in, which gives a deduction from entry to exit. Up a tree of bounded fan, the deductions
of neighbours are the edges of the next agenda. The goal is decided at the top, and the way it
takes is followed down to the blocks, which edit their rows. Equal rows of a conversation stand
next to each other and travel as one row with a count.

Only hashes of texts take part. Whole texts are shuffled once, to the rows that keep them.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store

#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows of a block, and blocks or deductions that an agenda joins at a time, as powers of two.
BLOCK_BITS, FAN_BITS = 6, 5
#: Derivations of blocks that a task remembers.
MEMO = 20_000
#: A character of a text that is not white space, and a text that ends with a full stop.
SOLID = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"

#: States: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES, ACCEPTED = range(4), (START, ASSISTANT)
NEXT = {
    (START, "s"): SYSTEM,
    (START, "u"): USER,
    (SYSTEM, "u"): USER,
    (ASSISTANT, "u"): USER,
    (USER, "a"): ASSISTANT,
}
LEGAL = ("su", "ua", "au")

Edge = tuple[int, int, int, str]


def lightest(edges: Callable[[int, int], list[Edge]], entry: int) -> dict[tuple[int, int], tuple]:
    """Each item (place, state) that can be derived from (0, entry), with the cost and audit of
    its lightest derivation and the item before. ``edges`` gives place, state, cost and audit of
    the edits that extend an item."""
    agenda: list[tuple] = [(0, "", 0, entry, (0, entry))]
    final: dict[tuple[int, int], tuple] = {}
    while agenda:
        cost, audit, place, state, before = heapq.heappop(agenda)
        if (place, state) in final:
            continue
        final[place, state] = cost, audit, before
        for to, after, weight, edit in edges(place, state):
            if (to, after) not in final:
                heapq.heappush(agenda, (cost + weight, audit + edit, to, after, (place, state)))
    return final


def wanted(state: int) -> str:
    """The initial of a row that is inserted, or gets another role, in a state."""
    return "a" if state == USER else "u"


def row_edges(rows: list[str]) -> Callable[[int, int], list[Edge]]:
    """Edits of rows. A row is the initial of its role, in upper case if it is truncated, any
    other letter being no role that fits; or ``x`` and the number of rows to delete there.

    Rows to delete are one deduction: an insertion amid deletions has the same cost as one behind
    them, and a greater audit.
    """

    def edges(place: int, state: int) -> list[Edge]:
        to = wanted(state)
        out = [(place, NEXT[state, to], INSERT, "I")]
        if place < len(rows):
            row = rows[place]
            if row[0] == "x":
                out.append((place + 1, state, DELETE * int(row[1:]), "D" * int(row[1:])))
            else:
                extra = TRUNCATED if row.isupper() else 0
                out.append((place + 1, state, DELETE, "D"))
                out.append((place + 1, NEXT[state, to], REROLE + extra, "R"))
                if (state, row.lower()) in NEXT:
                    out.append((place + 1, NEXT[state, row.lower()], extra, "K"))
        return out

    return edges


def deductions(edges: Callable[[int, int], list[Edge]], end: int) -> list[dict]:
    """From each state to each state at place ``end``."""
    out = []
    for entry in STATES:
        final = lightest(edges, entry)
        out += [
            {"entry": entry, "exit": q, "cost": final[end, q][0], "audit": final[end, q][1]}
            for q in STATES
            if (end, q) in final
        ]
    return out


def joined_edges(parts: list[list[dict]]) -> Callable[[int, int], list[Edge]]:
    """The deductions of neighbours as edits of an agenda over them."""

    def edges(place: int, state: int) -> list[Edge]:
        if place == len(parts):
            return []
        return [(place + 1, d["exit"], d["cost"], d["audit"]) for d in parts[place] if d["entry"] == state]

    return edges


def way(parts: list[list[dict]], entry: int, exit: int) -> list[tuple[int, int]]:
    """Entry and exit of each part on the lightest way."""
    final = lightest(joined_edges(parts), entry)
    at, states = (len(parts), exit), [exit]
    while at != (0, entry):
        at = final[at][2]
        states.append(at[1])
    states.reverse()
    return list(zip(states, states[1:]))


def edited(rows: list[dict], state: int, audit: str) -> Iterator[tuple[str, str | None, dict | None]]:
    """Edit, new role (None: its own) and row (None: inserted) of each row of the result."""
    place, done = 0, 0
    for edit in audit:
        if edit == "I":
            yield "I", "assistant" if state == USER else "user", None
            state = NEXT[state, wanted(state)]
            continue
        row = rows[place]
        if edit == "K":
            yield "K", None, row
            state = NEXT[state, row["letter"].lower()]
        elif edit == "R":
            yield "R", "assistant" if state == USER else "user", row
            state = NEXT[state, wanted(state)]
        done += 1
        if done == row["n"]:
            place, done = place + 1, 0


# -- Spark ------------------------------------------------------------------------------------

_DEDUCTIONS = "array<struct<entry:int,exit:int,cost:bigint,audit:string>>"
_DEDUCTIONS_ARROW = pa.list_(
    pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
)


def _tokens(rows: list[dict]) -> list[str]:
    """The rows of a block as ``row_edges`` takes them: copies of a row follow it as deletions."""
    out = []
    for row in rows:
        if row["letter"] == "x":
            out.append(f"x{row['n']}")
        else:
            out.append(row["letter"])
            if row["n"] > 1:
                out.append(f"x{row['n'] - 1}")
    return out


def _derive_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo: dict[str, list[dict]] = {}
    for batch in batches:
        out = []
        for rows in batch.column("rows").to_pylist():
            tokens = _tokens(rows)
            key = " ".join(tokens)
            found = memo.get(key)
            if found is None:
                if len(memo) >= MEMO:
                    memo.clear()
                found = memo[key] = deductions(row_edges(tokens), len(tokens))
            out.append(found)
        yield _with(batch, "deductions", pa.array(out, _DEDUCTIONS_ARROW))


def _join_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for parts in batch.column("parts").to_pylist():
            parts = [p["deductions"] for p in parts]
            out.append(parts[0] if len(parts) == 1 else deductions(joined_edges(parts), len(parts)))
        yield _with(batch, "deductions", pa.array(out, _DEDUCTIONS_ARROW))


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("node", pa.int64()), ("entry", pa.int32()), ("exit", pa.int32())]))
    for batch in batches:
        out = []
        for row in batch.select(["parts", "entry", "exit"]).to_pylist():
            states = way([p["deductions"] for p in row["parts"]], row["entry"], row["exit"])
            out.append([{"node": p["node"], "entry": a, "exit": b} for p, (a, b) in zip(row["parts"], states)])
        yield pa.RecordBatch.from_arrays([batch.column("conv"), pa.array(out, kind)], ["conv", "ways"])


def _edit_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(
        pa.struct(
            [("seq", pa.int64()), ("edit", pa.string()), ("new_role", pa.string()), ("role", pa.string()),
             ("print", pa.binary()), ("turn", pa.int64())]
        )
    )
    for batch in batches:
        out = []
        for block in batch.select(["rows", "deductions", "entry", "exit"]).to_pylist():
            audit = next(
                d["audit"] for d in block["deductions"] if (d["entry"], d["exit"]) == (block["entry"], block["exit"])
            )
            none = {"role": None, "print": None, "turn": None}
            found = enumerate(edited(block["rows"], block["entry"], audit))
            out.append(
                [
                    {"seq": i, "edit": edit, "new_role": role} | {k: (row or none)[k] for k in none}
                    for i, (edit, role, row) in found
                ]
            )
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), batch.column("node"), pa.array(out, kind)], ["conv", "node", "edits"]
        )


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, name])


def _ordered(rows: DataFrame) -> DataFrame:
    """Each different row of a conversation once, with its count and its number in one order."""
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("print")]
    each = rows.groupBy("conv", "turn", "role", "print", "blank", "truncated").agg(F.count("*").alias("n"))
    dealt = each.repartitionByRange(*order).sortWithinPartitions(*order)
    running = F.monotonically_increasing_id()
    kept = store(
        dealt.withColumn("part", F.shiftright(running, 33).cast("int"))
        .withColumn("place", running.bitwiseAND(F.lit((1 << 33) - 1))),
        "conversation-rows",
    )
    # As many rows as there are shuffle partitions.
    sizes = {r["part"]: r["n"] for r in kept.groupBy("part").agg(F.count("*").alias("n")).collect()}
    offsets, total = [], 0
    for part in range(max(sizes, default=-1) + 1):
        offsets.append(total)
        total += sizes.get(part, 0)
    offset = F.get(F.array(*[F.lit(x) for x in offsets]).cast("array<bigint>"), F.col("part"))
    return kept.withColumn("number", offset + F.col("place")).drop("part", "place")


def _facts(rows: DataFrame) -> DataFrame:
    """Gaps and faults of each conversation."""
    first = F.col("letter") != "x"
    fresh = F.when(first, 1).otherwise(0)
    counts = rows.groupBy("conv").agg(
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(~F.col("blank"), F.col("n") - fresh).otherwise(0)).alias("duplicate"),
        F.sum(F.when(first & F.col("truncated"), 1).otherwise(0)).alias("truncated"),
    )
    turns = rows.where(F.col("turn").isNotNull()).groupBy("conv", "turn").agg(F.lit(1).alias("one"))
    span = F.try_add(F.try_subtract(F.max("turn"), F.min("turn")), F.lit(1))
    gaps = turns.groupBy("conv").agg(F.try_subtract(span, F.count("*")).alias("gaps"))
    return counts.join(gaps, "conv", "left")


class Repaired(NamedTuple):
    """``summary``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, one row per
    conversation. ``turns``: conv_id, block, seq, edit, turn, role, text, the rows of the repaired
    conversations in the order of (block, seq)."""

    summary: DataFrame
    turns: DataFrame


def repair(rows: DataFrame) -> Repaired:
    """Repair conversations ``rows`` (conv_id, turn, role, text) with the cheapest edits.

    Rows of a conversation are taken by turn (nulls first), then by role and a hash of the text.
    The first fault of a row counts: blank (no character but white space), duplicate (role and
    text seen earlier), truncated (the last character that is not white space is none of
    ``.!?``). Blank and duplicate rows are deleted. ``illegal`` counts neighbours whose role
    initials are none of LEGAL. Of equally cheap repairs the one whose audit is least is taken.

    A null role or text is one space, so a null text is blank; an empty role fits nowhere. Rows
    without conv_id are one conversation. ``gaps`` is 0 without turns, and null if the turns span
    more than 64 bits. An empty table gives empty results; other columns do not matter.
    """
    given = rows.select(
        F.col("conv_id"),
        conversation(F.col("conv_id")).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    ).withColumn("print", F.unhex(F.sha2("text", 256)))
    solid = F.col("text").rlike(SOLID)
    slim = given.select(
        "conv", "turn", "role", "print", (~solid).alias("blank"), (solid & ~F.col("text").rlike(ENDED)).alias("truncated")
    )
    ordered = _ordered(slim)
    firsts = (
        ordered.where(~F.col("blank")).groupBy("conv", "role", "print").agg(F.min("number").alias("first")).select("first")
    )
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    letter = F.when(F.col("first").isNull(), "x").otherwise(F.when(F.col("truncated"), F.upper(known)).otherwise(known))
    marked = ordered.join(firsts, ordered["number"] == firsts["first"], "left").select(
        *ordered.columns, known.alias("initial"), letter.alias("letter")
    )
    marked = store(marked, "conversation-marked")

    # A block's rows; nodes of a conversation are numbered from 0.
    row = F.struct("number", "letter", "n", "initial", "role", "print", "turn")
    blocks = marked.groupBy("conv", F.shiftright("number", BLOCK_BITS).alias("block")).agg(
        F.array_sort(F.collect_list(row)).alias("rows")
    )
    spans = marked.groupBy("conv").agg(F.shiftright(F.min("number"), BLOCK_BITS).alias("lowest"))
    spans = spans.withColumnRenamed("conv", "of")
    blocks = blocks.join(spans, F.col("conv") == F.col("of")).select(
        "conv", (F.col("block") - F.col("lowest")).alias("node"), "rows"
    )
    inner = F.aggregate(F.transform("rows", lambda r: r["n"] - 1), F.lit(0).cast("long"), lambda a, b: a + b)
    pairs = F.transform(
        F.slice("rows", F.lit(2), F.greatest(F.size("rows") - 1, F.lit(0))),
        lambda r, i: F.concat(F.get("rows", i)["initial"], r["initial"]),
    )
    across = F.size(F.filter(pairs, lambda p: ~p.isin(*LEGAL)))
    blocks = blocks.withColumns(
        {
            "illegal": inner + across,
            "head": F.get("rows", F.lit(0))["initial"],
            "tail": F.element_at("rows", -1)["initial"],
        }
    )
    schema = f"{_ddl(blocks)}, deductions {_DEDUCTIONS}"
    blocks = store(blocks.mapInArrow(_derive_blocks, schema), "conversation-blocks")

    # Up the tree, level by level until each conversation is one node.
    level = blocks.drop("rows")
    levels = []
    most = level.agg(F.max("node")).first()[0] or 0
    while most > 0:
        part = F.struct("node", "deductions", "illegal", "head", "tail")
        grouped = level.groupBy("conv", F.shiftright("node", FAN_BITS).alias("parent")).agg(
            F.array_sort(F.collect_list(F.struct("node", part.alias("part")))).alias("parts")
        )
        grouped = grouped.withColumn("parts", F.transform("parts", lambda p: p["part"]))
        seams = F.transform(
            F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0))),
            lambda p, i: F.concat(F.get("parts", i)["tail"], p["head"]),
        )
        inside = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["illegal"])
        grouped = grouped.select(
            "conv",
            F.col("parent").alias("node"),
            "parts",
            (inside + F.size(F.filter(seams, lambda s: ~s.isin(*LEGAL)))).alias("illegal"),
            F.get("parts", F.lit(0))["head"].alias("head"),
            F.element_at("parts", -1)["tail"].alias("tail"),
        )
        schema = f"{_ddl(grouped)}, deductions {_DEDUCTIONS}"
        joined = store(grouped.mapInArrow(_join_parts, schema), "conversation-level")
        levels.append(joined)
        level = joined.drop("parts")
        most >>= FAN_BITS

    goal = F.array_min(
        F.transform(
            F.filter("deductions", lambda d: (d["entry"] == START) & d["exit"].isin(*ACCEPTED)),
            lambda d: F.struct(d["cost"].alias("cost"), d["audit"].alias("audit"), d["exit"].alias("exit")),
        )
    )
    decided = level.withColumn("goal", goal).select("conv", "node", "illegal", "goal.cost", "goal.audit", "goal.exit")
    names = given.groupBy("conv").agg(F.any_value("conv_id").alias("conv_id"))
    summary = (
        names.join(decided.drop("node", "exit"), "conv")
        .join(_facts(marked), "conv")
        .select(
            "conv_id",
            *[F.col(c).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
            "audit",
        )
        .withColumn("gaps", F.coalesce("gaps", F.lit(0).cast("long")))
    )

    # Down the tree: which state each node is entered and left in.
    states = decided.select("conv", "node", F.lit(START).alias("entry"), "exit")
    for joined in reversed(levels):
        down = joined.select("conv", "node", "parts").join(states, ["conv", "node"])
        ways = down.mapInArrow(_follow, "conv string, ways array<struct<node:bigint,entry:int,exit:int>>")
        states = ways.select("conv", F.inline("ways"))
    chosen = blocks.select("conv", "node", "rows", "deductions").join(states, ["conv", "node"])
    edit = "seq:bigint,edit:string,new_role:string,role:string,print:binary,turn:bigint"
    edits = chosen.mapInArrow(_edit_blocks, f"conv string, node bigint, edits array<struct<{edit}>>")
    edits = edits.select("conv", F.col("node").alias("block"), F.inline("edits"))
    kept, inserted = edits.where("print IS NOT NULL"), edits.where("print IS NULL")
    texts = given.groupBy("conv", "role", "print").agg(F.any_value("text").alias("text"))
    turns = kept.join(texts, ["conv", "role", "print"]).unionByName(inserted.withColumn("text", F.lit("")))
    turns = turns.join(names, "conv").select(
        "conv_id", "block", "seq", "edit", "turn", F.coalesce("new_role", "role").alias("role"), "text"
    )
    return Repaired(summary, turns)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def digests(turns: DataFrame) -> DataFrame:
    """conv_id and the sha256 of each conversation's ``role:text`` lines, joined by newlines.

    A digest reads its lines in order, so one task reads those of a conversation, one batch at a
    time after a sort that may spill.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state = None, None
        for batch in batches:
            ids, prints = [], []
            for key, line in zip(batch.column("key").to_pylist(), batch.column("line").to_pylist()):
                if key != own:
                    if state is not None:
                        ids.append(own)
                        prints.append(state.hexdigest())
                    own, state = key, hashlib.sha256(line.encode())
                else:
                    state.update(b"\n" + line.encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(prints, pa.string())], ["key", "sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([own]), pa.array([state.hexdigest()])], ["key", "sha256"])

    lines = turns.select(
        conversation(F.col("conv_id")).alias("key"), "block", "seq", F.concat("role", F.lit(":"), "text").alias("line")
    )
    sorted_lines = lines.repartition("key").sortWithinPartitions("key", "block", "seq").select("key", "line")
    return sorted_lines.mapInArrow(run, "key string, sha256 string")


def conversation(conv_id: Column) -> Column:
    """A name of a conversation that is never null and differs between null and any id."""
    return F.when(conv_id.isNull(), "").otherwise(F.concat(F.lit("="), conv_id.cast("string")))


def damage(rows: DataFrame) -> DataFrame:
    """The fixed damage of the contract: by crc32 of ``conv_id:turn`` modulo 20 a row is dropped
    (0), emptied (1), loses its ``.!?`` (2), is repeated (3) or gets the role user (4)."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where(kind != 0).select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(spaced("role")).alias("role"),
        text.alias("text"),
        F.explode(copies).alias("copy"),
    ).drop("copy")
