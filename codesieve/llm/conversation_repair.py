"""Conversation structure repair: the cheapest edits that make the turns' roles legal, by a checkpointed dynamic program.

The rows of a conversation, by turn (nulls first), are kept (cost 0), given the role user or assistant (1) or deleted (2),
and turns without text are inserted anywhere (5), so that the first letters of the roles read `(s?(ua)+)?`. A blank row, or
one whose role and text came before, has to go; a row that stays cut off (its last character is no `.`, `!` or `?`) adds
5. Of the cheapest edits those whose initials (K, R, D, I) are the least in ASCII are taken.

The program runs backwards over the rows: for each of four states (nothing yet, after s, u, a) the least cost of what is
left. Only every sqrt(n)-th vector is stored; the walk forward computes a block's vectors again from the next stored one
and takes the least initial among the edits that lie tight on the costs.

Rows are dealt by ranges of (conversation, turn), so a conversation of any size is spread over tasks in order. Those that
lie inside a range are repaired there. The first and last of each range may go on in its neighbours: a task sends their
rows in blocks, the cost of crossing its rows from each state to each other (sixteen numbers), and these chain to the cost
vector at the end of each range, a checkpoint like the others; each range is then walked from every state it may be
entered in, and the states that meet are taken. Whether a row came before is found by grouping, for all rows.

Rows of one turn are taken by role, then by the first 64 characters of the text, then by a digest. A null conv_id is a
conversation. A null role or text is one space. A role that starts with none of s, u, a can't be kept. A conversation
without rows needs no edits; an empty table gives no rows. Texts of any length are read whole; other columns are not
looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from math import isqrt
from typing import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.llm.common import settle, ship

BLANKS, STOPS, BLOCK_ROWS = " \t\n\x0b\x0c\r", (".", "!", "?"), 512
DELETE, REROLE, INSERT, CUT = 2, 1, 5, 5
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a. The letters that may follow each, and the turn that leads on.
FOLLOW, NEXT, NAMES = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}), (2, 2, 3, 2), ("", "", "user", "assistant")
FAR = 1 << 60
#: Least cost after the last row: turns inserted until the grammar is met.
END = [0, 2 * INSERT, INSERT, 0]
LEGAL = {"su", "ua", "au"}
TURNS = "turns array<struct<role:string,text:string>>"
STATS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
STAT_NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def fault(text: str, repeated: bool) -> str:
    text = text.rstrip(BLANKS)
    return "blank" if not text else "duplicate" if repeated else "" if text.endswith(STOPS) else "truncated"


def moves(initial: str, wrong: str, known: dict = {}) -> list[list[tuple[str, int, int]]]:  # noqa: B006 - a table of the few forms there are
    """For each state the edits of a row as (initial, cost, state after), in ASCII order."""
    out = known.get((initial, wrong))
    if out is None:
        extra, out = CUT if wrong == "truncated" else 0, []
        for state in range(4):
            row = [("D", DELETE, state)]
            if wrong not in ("blank", "duplicate"):
                row += [("K", extra, FOLLOW[state][initial])] if initial in FOLLOW[state] else []
                row.append(("R", REROLE + extra, NEXT[state]))
            out.append(row)
        if initial in ("s", "u", "a"):
            known[initial, wrong] = out
    return out


def before(row: tuple[str, str], after: list[int]) -> list[int]:
    """The cost vector ahead of a row from the one behind it; turns may be inserted ahead of the row."""
    v = [min([cost + after[to] for _, cost, to in options]) for options in moves(*row)]
    user, assistant = min(v[2], INSERT + v[3]), min(v[3], INSERT + v[2])
    return [min(v[0], INSERT + user), min(v[1], INSERT + user), user, assistant]


def crossing(rows: list[tuple[str, str]]) -> list[int]:
    """Least cost of coming over the rows from each state (outer) to each state (inner)."""
    columns = []
    for to in range(4):
        v = [0 if s == to else FAR for s in range(4)]
        for row in reversed(rows):
            v = before(row, v)
        columns.append(v)
    return [min(FAR, columns[to][s]) for s in range(4) for to in range(4)]


def walk(rows: list[tuple[str, str]], end: list[int], state: int) -> Iterator[tuple[int, str, int]]:
    """(row, edit, state after) of the ASCII-least cheapest edits, for rows entered in a state; end: costs behind them."""
    n, step = len(rows), isqrt(len(rows)) + 1
    stored, v = {n: end}, end
    for i in range(n - 1, -1, -1):
        v = before(rows[i], v)
        if i % step == 0:
            stored[i] = v
    for first in range(0, n, step):
        last = min(n, first + step)
        block = [stored[last]]
        for i in range(last - 1, first - 1, -1):
            block.append(before(rows[i], block[-1]))
        block.reverse()
        for i in range(first, last):
            here, behind = block[i - first], block[i - first + 1]
            edit = ""
            while not edit or edit == "I":
                left = here[state]
                edits = {e: to for e, cost, to in moves(*rows[i])[state] if cost + behind[to] == left}
                if INSERT + here[NEXT[state]] == left:
                    edits["I"] = NEXT[state]
                edit = min(edits)
                state = edits[edit]
                yield i, edit, state


def closing(state: int) -> Iterator[int]:
    """States of the turns inserted behind the last row."""
    while state in (1, 2):
        state = NEXT[state]
        yield state


def repaired(items: list[dict], edits: Iterator[tuple[int, str, int]]) -> tuple[str, list[dict], int | None]:
    """Edits' initials, the turns that stay, and the state at the end (None if there was no edit)."""
    letters, turns, state = [], [], None
    for i, edit, state in edits:
        letters.append(edit)
        if edit == "K":
            turns.append({"role": items[i]["role"], "text": items[i]["text"]})
        elif edit != "D":
            turns.append({"role": NAMES[state], "text": items[i]["text"] if edit == "R" else ""})
    return "".join(letters), turns, state


def tally(items: list[dict]) -> dict:
    """What neighbouring ranges need to know of a run of rows, besides its counts."""
    turns = [i["turn"] for i in items if i["turn"] is not None]
    initials = [i["role"][:1] for i in items]
    faults = [i["fault"] for i in items]
    return {"low": turns[0] if turns else None, "high": turns[-1] if turns else None, "different": len(set(turns)),
            "head": initials[0] if items else None, "tail": initials[-1] if items else None,
            **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
            "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))}


def gaps(low: int | None, high: int | None, different: int) -> int:
    return 0 if low is None else high - low + 1 - different


def _forms(items: list[dict]) -> list[tuple[str, str]]:
    return [(i["role"][:1], i["fault"]) for i in items]


def _ordered(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone, again (role and text came before), in order within ranges."""
    text, role = F.coalesce(F.col("text"), F.lit(" ")), F.coalesce(F.col("role"), F.lit(" "))
    name = F.coalesce(F.col("conv_id").cast("string"), F.lit("none"))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
                       F.col("gone").alias("gone"), F.col("copy").alias("copy"), F.monotonically_increasing_id().alias("row_no"),
                       F.unhex(F.md5(F.concat_ws(":", name, F.length(role).cast("string"), role, text).cast("binary"))).alias("mark"))
    rows = settle(rows, "op12-rows")
    place = F.struct("turn", "row_no", "copy")
    repeats = rows.where(~F.col("gone")).groupBy("mark").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("mark", "first")
    # Stored, so that a join with them has an exchange on both sides and Spark can split the rows of a very common mark.
    repeats = settle(repeats, "op12-repeats")
    flagged = rows.join(repeats, "mark", "left").withColumn("again", F.col("first").isNotNull() & (place != F.col("first")))
    order = ["conv_id", "turn", "role", "head", "mark", "row_no", "copy"]
    flagged = flagged.withColumn("head", F.substring("text", 1, 64))
    return flagged.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "gone", "again")


def _by_range(rows: DataFrame) -> DataFrame:
    """Repaired conversations (block -1), and blocks of rows of those that may go on in other ranges."""
    types = {"conv_id": pa.int64(), "part": pa.int64(), "block": pa.int64(), "edits": pa.string(),
             "turns": pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])),
             "items": pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.string())])),
             **dict.fromkeys(STAT_NAMES, pa.int64())}
    schema = pa.schema(list(types.items()))

    def whole(conv_id: int | None, items: list[dict], part: int) -> list[dict]:
        forms, t = _forms(items), tally(items)
        letters, turns, state = repaired(items, walk(forms, END, 0))
        late, v = list(closing(state or 0)), END
        for row in reversed(forms):
            v = before(row, v)
        return [{"conv_id": conv_id, "part": part, "block": -1, "edits": letters + "I" * len(late), "turns": turns + [{"role": NAMES[s], "text": ""} for s in late],
                 "gaps": gaps(t["low"], t["high"], t["different"]), "blank": t["blank"], "duplicate": t["duplicate"], "truncated": t["truncated"],
                 "illegal": t["illegal"], "cost": v[0]}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, items, first, blocks = TaskContext.get().partitionId(), None, [], True, 0
        started, out = False, []

        def block(conv_id: int | None, rows: list[dict], no: int) -> dict:
            return {"conv_id": conv_id, "part": part, "block": no, "items": rows}

        for batch in batches:
            for conv_id, turn, role, text, gone, again in zip(*(c.to_pylist() for c in batch.columns)):
                if not started or conv_id != now:
                    if started:
                        out += [block(now, items, blocks)] if first else whole(now, items, part)
                        first = False
                    started, now, items, blocks = True, conv_id, [], 0
                if not gone:
                    items.append({"turn": turn, "role": role, "text": text, "fault": fault(text, again)})
                    if first and len(items) >= BLOCK_ROWS:
                        out.append(block(now, items, blocks))
                        items, blocks = [], blocks + 1
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        # The last run may go on as well.
        for at in range(0, max(1, len(items)), BLOCK_ROWS) if started else ():
            out.append(block(now, items[at:at + BLOCK_ROWS], blocks + at // BLOCK_ROWS))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    ddl = f"conv_id long, part long, block long, edits string, {TURNS}, items array<struct<turn:long,role:string,text:string,fault:string>>, {STATS}"
    return settle(rows.mapInArrow(run, ddl), "op12-ranges")


def _items(table: pa.Table) -> list[list[dict]]:
    """The blocks of a run, in order."""
    return [r["items"] for r in sorted(table.select(["block", "items"]).to_pylist(), key=lambda r: r["block"])]


def _chained(blocks: DataFrame) -> DataFrame:
    """conv_id, part, behind (cost vector at the end of the range) and the whole conversation's counts, for every open run."""
    ddl = ("conv_id long, part long, low long, high long, different long, head string, tail string, blank long, duplicate long, truncated long, illegal long, "
           "cross array<long>")
    kinds = [(n, pa.string() if n in ("head", "tail") else pa.list_(pa.int64()) if n == "cross" else pa.int64()) for n in (f.split()[0] for f in ddl.split(", "))]

    def measure(key: tuple, table: pa.Table) -> pa.Table:
        items = [i for b in _items(table) for i in b]
        return pa.Table.from_pylist([{"conv_id": key[0].as_py(), "part": key[1].as_py(), **tally(items), "cross": crossing(_forms(items))}], pa.schema(kinds))

    def chain(key: tuple, table: pa.Table) -> pa.Table:
        runs = sorted(table.to_pylist(), key=lambda r: r["part"])
        behind, v = [], END
        for r in reversed(runs):
            behind.append(v)
            v = [min(r["cross"][4 * s + to] + v[to] for to in range(4)) for s in range(4)]
        sides = [r for r in runs if r["head"] is not None]
        turned = [r for r in runs if r["low"] is not None]
        different = sum(r["different"] for r in turned) - sum(a["high"] == b["low"] for a, b in zip(turned, turned[1:]))
        stats = {n: sum(r[n] for r in runs) for n in ("blank", "duplicate", "truncated", "illegal")}
        stats["illegal"] += sum(a["tail"] + b["head"] not in LEGAL for a, b in zip(sides, sides[1:]))
        stats |= {"gaps": gaps(turned[0]["low"], turned[-1]["high"], different) if turned else 0, "cost": v[0]}
        return pa.Table.from_pylist([{"conv_id": key[0].as_py(), "part": r["part"], "behind": b, **stats} for r, b in zip(runs, reversed(behind))],
                                    pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("behind", pa.list_(pa.int64())), *((n, pa.int64()) for n in STAT_NAMES)]))

    runs = blocks.groupBy("conv_id", "part").applyInArrow(measure, ddl)
    # At most two open runs come from a range: a conversation has as many as it has ranges.
    return runs.groupBy("conv_id").applyInArrow(chain, f"conv_id long, part long, behind array<long>, {STATS}")


def _open(blocks: DataFrame) -> DataFrame:
    """conv_id, part, block, edits, turns and counts of the conversations that touch the end of a range."""
    ends = settle(_chained(blocks), "op12-ends").select(F.col("conv_id").alias("end_id"), F.col("part").alias("end_part"), "behind", *STAT_NAMES)
    rows = blocks.select("conv_id", "part", "block", "items").join(ends, F.col("conv_id").eqNullSafe(F.col("end_id")) & (F.col("part") == F.col("end_part")))
    turns = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("entry", pa.int64()), ("block", pa.int64()), ("leave", pa.int64()), ("edits", pa.string()),
                        ("turns", turns), *((n, pa.int64()) for n in STAT_NAMES)])

    def variants(key: tuple, table: pa.Table) -> pa.Table:
        stats = table.select([*STAT_NAMES, "behind"]).slice(0, 1).to_pylist()[0]
        behind = stats.pop("behind")
        items = [i for b in _items(table) for i in b]
        forms, out = _forms(items), []
        for entry in range(4):
            state, part, no = entry, [], 0
            made = []
            for edit in walk(forms, behind, entry):
                part.append(edit)
                state = edit[2]
                if len(part) >= BLOCK_ROWS and edit[1] != "I":
                    made.append(part)
                    part = []
            made += [part] if part or not made else []
            for no, edits in enumerate(made):
                letters, kept, _ = repaired(items, iter(edits))
                out.append({"conv_id": key[0].as_py(), "part": key[1].as_py(), "entry": entry, "block": no, "leave": state, "edits": letters, "turns": kept, **stats})
        return pa.Table.from_pylist(out, schema)

    made = rows.groupBy("conv_id", "part").applyInArrow(variants, f"conv_id long, part long, entry long, block long, leave long, edits string, {TURNS}, {STATS}")
    made = made.repartition("conv_id").sortWithinPartitions("conv_id", "part", "entry", "block")
    out_schema = pa.schema([f for f in schema if f.name not in ("entry", "leave")])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows pass by in order; those entered in the state that the range before left stay."""
        started, now, part, state, left, stats = False, None, None, 0, 0, {}

        def end() -> list[dict]:
            late = list(closing(left))
            return [{"conv_id": now, "part": part + 1, "block": 0, "edits": "I" * len(late), "turns": [{"role": NAMES[s], "text": ""} for s in late], **stats}] if late else []

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if not started or r["conv_id"] != now:
                    out += end() if started else []
                    started, now, part, state, left = True, r["conv_id"], r["part"], 0, 0
                if r["part"] != part:
                    part, state = r["part"], left
                entry, leave = r.pop("entry"), r.pop("leave")
                if entry == state:
                    left, stats = leave, {n: r[n] for n in STAT_NAMES}
                    out.append(r)
            if out:
                yield pa.RecordBatch.from_pylist(out, out_schema)
        if started and end():
            yield pa.RecordBatch.from_pylist(end(), out_schema)
    return made.mapInArrow(joined, f"conv_id long, part long, block long, edits string, {TURNS}, {STATS}")


def repair(conversations: DataFrame) -> DataFrame:
    """Repaired conversations: conv_id, part, block, edits (initials), turns (role, text) and the counts of the conversation.

    A conversation is one row with block -1, or rows to be read by part and block, each of some hundred turns, with the
    same counts on each.
    """
    return repair_rows(conversations.select("conv_id", "turn", "role", "text", F.lit(False).alias("gone"), F.lit(0).alias("copy")))


def repair_rows(rows: DataFrame) -> DataFrame:
    """repair() for rows with two columns more: `gone` marks rows that only name their conversation, `copy` tells rows apart that come from one."""
    ranges = _by_range(_ordered(rows))
    closed = ranges.where("block = -1").select("conv_id", "part", "block", "edits", "turns", *STAT_NAMES)
    return closed.unionByName(settle(_open(ranges.where("block >= 0")), "op12-open"))


def digests(blocks: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of repaired conversations."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    names = ["conv_id", *STAT_NAMES, "audit", "repaired_sha256"]
    closed = blocks.where("block = -1").select("conv_id", *STAT_NAMES, F.col("edits").alias("audit"), F.sha2(lines, 256).alias("repaired_sha256"))
    ordered = blocks.where("block >= 0").repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    schema = pa.schema([(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A digest needs its text in order; only one block at a time is held."""
        done: dict = {}
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if not done or r["conv_id"] != done["conv_id"]:
                    out += [finished(done)] if done else []
                    done = {**{n: r[n] for n in ("conv_id", *STAT_NAMES)}, "audit": [], "sha": hashlib.sha256(), "any": False}
                done["audit"].append(r["edits"])
                for t in r["turns"]:
                    done["sha"].update(("\n" * done["any"] + t["role"] + ":" + t["text"]).encode("utf-8", "surrogatepass"))
                    done["any"] = True
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if done:
            yield pa.RecordBatch.from_pylist([finished(done)], schema)

    def finished(done: dict) -> dict:
        return {**{n: done[n] for n in ("conv_id", *STAT_NAMES)}, "audit": "".join(done["audit"]), "repaired_sha256": done["sha"].hexdigest()}
    return closed.unionByName(ordered.mapInArrow(run, f"conv_id long, {STATS}, audit string, repaired_sha256 string"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults set by a checksum of `conv_id:turn`, modulo 20; a dropped row stays as a mark of its conversation."""
    blank = F.lit(" ")
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(name.cast("binary")) % 20
    text, role = F.coalesce(F.col("text"), blank), F.coalesce(F.col("role"), blank)
    rows = conversations.select("conv_id", "turn", kind.alias("kind"), role.alias("role"), text.alias("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("gone"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def decisions(conversations: DataFrame) -> DataFrame:
    """The contract's row for every conv_id: damage, repair, digest."""
    return digests(repair_rows(damaged(conversations)))


ship(__name__)
