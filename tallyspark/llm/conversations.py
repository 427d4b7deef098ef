"""Repair of conversation structure: the cheapest edits after which the roles read (system?) (user assistant)*.

Four states accept the wanted roles: nothing yet, after the system turn, after a user turn, after an assistant
turn. A row is kept, given another role or deleted, with rows inserted before it; so each row is a 4 x 4 table
of costs from the state before it to the state right after it. The edits are found by Hirschberg's divide and
conquer: a forward cost vector meets a backward one in the middle of the conversation, the crossing with the
least sum is fixed, and both halves are solved by themselves, so that only two vectors are held at a time.

Among equally cheap edits those with the least audit (their initials in order) are wanted. A forward audit ends
with the edit of a row and holds one such edit for each row, so none is the beginning of another, and those of
two states differ. The forward vector therefore carries the order of its four audits beside the costs, and of
the cheapest crossings the one whose forward audit comes first is taken; the audits themselves are never built.

Long conversations are cut into blocks of `FAN` rows. A block's own table of costs and audit orders stands for
its rows, so blocks are solved like rows, level by level, until a conversation is one block; the states fixed
above are then handed down to the blocks below. No task holds more than `FAN` rows of a conversation.
"""

from __future__ import annotations

import hashlib
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, written
from .sharding import row_numbers

FAN = 4096
SPACE = " \t\n\x0b\f\r"
STATES = range(4)
START, SYSTEM, USER, ASSISTANT = STATES
NEXT = {
    (START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER,
}
# The one role that may come next without a system turn, and the state it leads to.
TURN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
# Rows inserted at the end until the roles are whole; their number is at most two.
ENDS = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
RELABEL, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NEVER = 1 << 60


class Costs:
    """Costs of a row or block between states, and for each state before it the order of the audits."""

    def __init__(self, cost: list[list[int]], order: list[list[int]]) -> None:
        self.cost, self.order = cost, order


def edits_of(kind: str, before: int) -> dict[int, tuple[int, str]]:
    """Cheapest edits of one row by the state after it: (cost, audit). kind: d to be deleted, else the role's initial, upper-cased where truncated."""
    found: dict[int, tuple[int, str]] = {}
    state = before
    for inserted in range(3):
        open_end = TRUNCATED if kind.isupper() else 0
        ways = [("D", state, DELETE)]
        if kind != "d":
            ways += [("R", TURN[state], RELABEL + open_end)]
            if (state, kind.lower()) in NEXT:
                ways += [("K", NEXT[state, kind.lower()], open_end)]
        for letter, after, cost in ways:
            way = (INSERT * inserted + cost, "I" * inserted + letter)
            found[after] = min(found.get(after, way), way)
        state = TURN[state]
    return found


@cache
def costs_of(kind: str) -> Costs:
    cost, order = [], []
    for before in STATES:
        found = edits_of(kind, before)
        audits = sorted(found, key=lambda s: found[s][1])
        cost.append([found[s][0] if s in found else NEVER for s in STATES])
        order.append([audits.index(s) if s in audits else 4 for s in STATES])
    return Costs(cost, order)


def forward(parts: list[Costs], before: int) -> tuple[list[int], list[int]]:
    """Least costs from `before` to each state after the parts, and the order of their least audits."""
    cost, order = [0 if s == before else NEVER for s in STATES], [0] * 4
    for part in parts:
        reached = []
        for s in STATES:
            best = min((cost[p] + part.cost[p][s], order[p], p) for p in STATES)
            reached.append((best[0], (best[1], part.order[best[2]][s]) if best[0] < NEVER else (4, 4)))
        ranks = sorted({audit for _, audit in reached})
        cost, order = [min(c, NEVER) for c, _ in reached], [ranks.index(audit) for _, audit in reached]
    return cost, order


def backward(parts: list[Costs], after: int) -> list[int]:
    """Least costs from each state before the parts to `after`."""
    cost = [0 if s == after else NEVER for s in STATES]
    for part in reversed(parts):
        cost = [min(NEVER, *(part.cost[p][s] + cost[s] for s in STATES)) for p in STATES]
    return cost


def last_state(parts: list[Costs], before: int) -> int:
    """The state before the rows inserted at the end, of the cheapest edits with the least audit."""
    cost, order = forward(parts, before)
    return min(STATES, key=lambda s: (cost[s] + INSERT * ENDS[s], order[s]))


def crossings(parts: list[Costs], before: int, after: int) -> list[int]:
    """States before each part and after the last one, by Hirschberg's method."""
    states = [before] * len(parts) + [after]
    halves = [(0, len(parts))]
    while halves:
        low, high = halves.pop()
        if high - low < 2:
            continue
        middle = (low + high) // 2
        cost, order = forward(parts[low:middle], states[low])
        rest = backward(parts[middle:high], states[high])
        states[middle] = min(STATES, key=lambda s: (cost[s] + rest[s], order[s]))
        halves += [(low, middle), (middle, high)]
    return states


def audit_of(kinds: str, before: int, after: int | None) -> tuple[str, int]:
    """Audit and cost of a block of rows; without `after` the block ends the conversation."""
    parts = [costs_of(k) for k in kinds]
    end = last_state(parts, before) if after is None else after
    states = crossings(parts, before, end)
    chosen = [edits_of(k, states[i])[states[i + 1]] for i, k in enumerate(kinds)]
    closing = ENDS[end] if after is None else 0
    return "".join(a for _, a in chosen) + "I" * closing, sum(c for c, _ in chosen) + INSERT * closing


def _rows(batch: pa.RecordBatch):
    return zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True)


def _batch(rows: list[tuple], like: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(like)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, like, strict=True)], schema=like)


def _parts(held) -> list[Costs]:
    if isinstance(held, str):
        return [costs_of(k) for k in held]
    return [Costs([x[4 * p : 4 * p + 4] for p in STATES], [x[16 + 4 * p : 20 + 4 * p] for p in STATES]) for x in held]


def _summaries(conv: pa.DataType):
    like = pa.schema([("conv_id", conv), ("block", pa.int64()), ("costs", pa.list_(pa.int64()))])

    def summarise(batches):
        for batch in batches:
            rows = []
            for conv_id, block, held in _rows(batch):
                ends = [forward(_parts(held), p) for p in STATES]
                rows.append((conv_id, block, [x for c, _ in ends for x in c] + [x for _, o in ends for x in o]))
            yield _batch(rows, like)

    return summarise


def _handed_down(conv: pa.DataType, fan: int):
    like = pa.schema([("conv_id", conv), ("block", pa.int64()), ("before", pa.int32()), ("after", pa.int32())])

    def solve(batches):
        for batch in batches:
            rows = []
            for conv_id, block, held, before, after in _rows(batch):
                parts = _parts(held)
                states = crossings(parts, before, last_state(parts, before) if after is None else after)
                # Only the last block closes the conversation; its end is left open again.
                ends = states[1:] if after is not None else [*states[1:-1], None]
                rows += [(conv_id, block * fan + i, states[i], ends[i]) for i in range(len(parts))]
            yield _batch(rows, like)

    return solve


def _audits(conv: pa.DataType):
    like = pa.schema([("conv_id", conv), ("block", pa.int64()), ("before", pa.int32()), ("audit", pa.string()), ("cost", pa.int64())])

    def solve(batches):
        known = Memo(lambda key: audit_of(*key), 100_000)
        for batch in batches:
            rows = []
            for conv_id, block, kinds, before, after in _rows(batch):
                key = (kinds, before, after)
                rows.append((conv_id, block, before, *(known[key] if len(kinds) <= 32 else audit_of(*key))))
            yield _batch(rows, like)

    return solve


def block_audits(kinds: DataFrame, fan: int = FAN) -> DataFrame:
    """conv_id, block, before, audit, cost of each block of rows; `kinds`: conv_id, block, held (a letter per row)."""
    conv = pa.int64()
    levels = [written(kinds)]
    while (levels[-1].agg(F.max("block").alias("n")).first()["n"] or 0) > 0:
        tables = levels[-1].mapInArrow(_summaries(conv), "conv_id long, block long, costs array<long>")
        above = tables.groupBy("conv_id", F.expr(f"block div {fan}").alias("above")).agg(
            F.array_sort(F.collect_list(F.struct("block", "costs"))).alias("held")
        )
        levels.append(written(above.select("conv_id", F.col("above").alias("block"), F.col("held.costs").alias("held"))))
    none = F.lit(None).cast("int")
    asked = levels.pop().select("conv_id", "block", "held", F.lit(START).alias("before"), none.alias("after"))
    while levels:
        states = asked.mapInArrow(_handed_down(conv, fan), "conv_id long, block long, before int, after int").alias("s")
        below = levels.pop().alias("b")
        same = F.col("s.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("s.block") == F.col("b.block"))
        asked = below.join(states, same).select("b.conv_id", "b.block", "b.held", "s.before", "s.after")
    return asked.mapInArrow(_audits(conv), "conv_id long, block long, before int, audit string, cost long")


def faults(conversations: DataFrame) -> DataFrame:
    """Distinct rows with their number and first fault: conv_id, turn, role, text, n, fault, copies.

    `fault` is that of the first of the n equal rows, `copies` that of the others. blank: no character but
    white space; duplicate: role and text were seen earlier; truncated: the last other character is not . ! or ?
    """
    space = F.lit(SPACE)
    filled = [F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")]
    ids = [F.col(c).cast("long").alias(c) for c in ("conv_id", "turn")]
    rows = conversations.select(*ids, *filled).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    rows = rows.withColumn("__text", F.sha2("text", 256))
    seen = rows.groupBy("conv_id", "role", "__text").agg(F.min(F.struct("turn")).alias("first"))
    r, s = rows.alias("r"), seen.alias("s")
    same = F.col("r.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("r.role") == F.col("s.role")) & (F.col("r.__text") == F.col("s.__text"))
    blank = F.length(F.btrim("text", space)) == 0
    ended = F.right(F.rtrim("text", space), F.lit(1)).isin(".", "!", "?")
    fault = F.when(blank, "blank").when(~F.col("turn").eqNullSafe(F.col("first.turn")), "duplicate").when(~ended, "truncated").otherwise("none")
    joined = r.join(s, same).select("r.conv_id", "turn", "r.role", "text", "n", "first")
    return joined.select("conv_id", "turn", "role", "text", "n", fault.alias("fault"), F.when(blank, "blank").otherwise("duplicate").alias("copies"))


def _letters(rows: DataFrame, fan: int) -> DataFrame:
    """conv_id, block, held: one letter for each row of a block, see `edits_of`."""
    initial = F.substring("role", 1, 1)
    role = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    dead = F.col("fault").isin("blank", "duplicate")
    letter = F.when(dead, "d").when(F.col("fault") == "truncated", F.upper(role)).otherwise(role)
    runs = F.array(
        F.struct(F.col("at").alias("low"), F.col("at").alias("high"), letter.alias("k")),
        F.struct((F.col("at") + 1).alias("low"), (F.col("at") + F.col("n") - 1).alias("high"), F.lit("d").alias("k")),
    )
    runs = rows.select("conv_id", F.explode(F.filter(runs, lambda x: x["high"] >= x["low"])).alias("run"))
    blocks = F.explode(F.sequence(F.expr(f"run.low div {fan}"), F.expr(f"run.high div {fan}")))
    cut = runs.select("conv_id", "run", blocks.alias("block")).withColumns({
        "low": F.greatest("run.low", F.col("block") * fan), "high": F.least("run.high", F.col("block") * fan + fan - 1),
    })
    text = F.expr("repeat(run.k, CAST(high - low + 1 AS INT))").alias("text")
    return cut.groupBy("conv_id", "block").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("low", text)))["text"], "").alias("held")
    )


REPAIRED = "conv_id long, place long, edit string, cost long, turn long, old_role string, fault string, role string, text string"


def _applied(batches):
    """Repaired rows of sorted conversations; the audit of a block comes before its rows."""
    like = pa.schema([
        ("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("cost", pa.int64()), ("turn", pa.int64()),
        ("old_role", pa.string()), ("fault", pa.string()), ("role", pa.string()), ("text", pa.string()),
    ])
    names = {USER: "user", ASSISTANT: "assistant"}
    out: list[tuple] = []
    conv, place, state, audit, at = object(), 0, START, "", 0

    def put(letter, cost, turn=None, old=None, fault=None, role=None, text=""):
        nonlocal place
        out.append((conv, place, letter, cost, turn, old, fault, role, text))
        place += 1

    def inserts():
        nonlocal at, state
        while audit[at : at + 1] == "I":
            state, at = TURN[state], at + 1
            put("I", INSERT, role=names[state])

    size = 0
    for batch in batches:
        for conv_id, _, _, turn, role, text, n, fault, copies, told in _rows(batch):
            if conv_id != conv:
                inserts()
                conv, place, state, audit, at = conv_id, 0, START, "", 0
            if told is not None:
                inserts()
                audit, at = audit[at:] + told, 0
                continue
            for copy in range(n):
                inserts()
                letter, why = audit[at], copies if copy else fault
                at += 1
                open_end = TRUNCATED if why == "truncated" else 0
                if letter == "D":
                    put("D", DELETE, turn, role, why, role, text)
                elif letter == "R":
                    state = TURN[state]
                    put("R", RELABEL + open_end, turn, role, why, names[state], text)
                else:
                    state = NEXT[state, role[:1]]
                    put("K", open_end, turn, role, why, role, text)
                size += len(text)
                if len(out) >= 1000 or size > 4_000_000:
                    yield _batch(out, like)
                    out.clear()
                    size = 0
    inserts()
    yield _batch(out, like)


def repair(conversations: DataFrame, fan: int = FAN) -> DataFrame:
    """All rows of the repaired conversations and those deleted, one edit each.

    Returns conv_id, place (from 0 in a conversation, gapless), edit (K keep, R give another role, D delete, I insert),
    cost, turn, old_role, fault (none, blank, duplicate, truncated; null for an inserted row), role, text. Without the rows
    of edit D the roles of a conversation are (system?) (user assistant)*, told by their initials.

    Blank and duplicate rows are deleted, truncated rows that stay cost one more. Rows are read by turn, nulls first,
    then by role and text; a null role or text is one space, and rows with a null conv_id are one conversation. Repeated
    rows are duplicates of the first. A role without an initial can't be kept. Other columns are not read; an empty
    table gives an empty one.
    """
    tagged = faults(conversations)
    numbered = row_numbers(tagged, ["conv_id", "turn", "role", "text"], "pos", "n")
    first = numbered.groupBy("conv_id").agg(F.min("pos").alias("first")).alias("f")
    r = numbered.alias("r")
    rows = r.join(first, F.col("r.conv_id").eqNullSafe(F.col("f.conv_id"))).select("r.*", (F.col("pos") - F.col("first")).alias("at"))
    audits = block_audits(_letters(rows.drop("text"), fan), fan)
    none = {c: F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("n", "long"), ("fault", "string"), ("copies", "string"), ("audit", "string"))}
    told = audits.select("conv_id", (F.col("block") * fan).alias("at"), F.lit(0).alias("kind"), *[none[c] for c in ("turn", "role", "text", "n", "fault", "copies")], "audit")
    # A row of many copies may reach into later blocks, so it comes after all their audits.
    last = F.expr(f"((at + n - 1) div {fan}) * {fan}")
    kept = rows.select("conv_id", F.greatest("at", last).alias("at"), F.lit(1).alias("kind"), "turn", "role", "text", "n", "fault", "copies", none["audit"])
    return told.union(kept).repartition("conv_id").sortWithinPartitions("conv_id", "at", "kind").mapInArrow(_applied, REPAIRED)


REPORT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


def _reported(batches):
    like = pa.schema([("conv_id", pa.int64())] + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string()), ("repaired_sha256", pa.string())])
    out: list[tuple] = []
    conv, found = object(), None

    def close():
        if found:
            gaps = found["high"] - found["low"] + 1 - found["turns"] if found["turns"] else 0
            counts = [found[c] for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
            out.append((conv, gaps, *counts, "".join(found["audit"]), found["hash"].hexdigest()))

    for batch in batches:
        for conv_id, _, edit, cost, turn, old_role, fault, role, text in _rows(batch):
            if conv_id != conv:
                close()
                conv = conv_id
                found = dict.fromkeys(("blank", "duplicate", "truncated", "none", "illegal", "cost", "turns"), 0)
                found |= {"audit": [], "hash": hashlib.sha256(), "low": None, "high": None, "initial": None, "rows": 0}
            found["audit"].append(edit)
            found["cost"] += cost
            if edit != "I":
                found[fault] += 1
                initial = old_role[:1]
                if found["initial"] is not None and found["initial"] + initial not in ("su", "ua", "au"):
                    found["illegal"] += 1
                found["initial"] = initial
                if turn is not None and turn != found["high"]:
                    found["low"], found["high"] = turn if found["low"] is None else found["low"], turn
                    found["turns"] += 1
            if edit != "D":
                found["hash"].update(f"{chr(10) if found['rows'] else ''}{role}:{text}".encode())
                found["rows"] += 1
        yield _batch(out, like)
        out.clear()
    close()
    yield _batch(out, like)


def report(repaired: DataFrame) -> DataFrame:
    """One row for each conversation of `repair`: its faults, the edits, their cost and a hash of what it became.

    Returns conv_id, gaps (turn numbers missing between the first and the last), blank, duplicate, truncated, illegal
    (neighbours whose initials are not su, ua or au, before the repair), cost, audit, repaired_sha256 (of the lines
    role:text). Each conversation is streamed in order through one task; only its counts, its audit and the hash's state
    are held.
    """
    return repaired.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(_reported, REPORT)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in by the checksum of `conv_id:turn` modulo 20; nulls become one space.

    0 drops the row, 1 empties its text, 2 takes out . ! and ?, 3 repeats it, 4 makes its role user.
    """
    ids = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    way = F.crc32(F.concat(ids[0], F.lit(":"), ids[1])) % 20
    filled = conversations.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")], way.alias("__way"))
    text = F.when(F.col("__way") == 1, "").when(F.col("__way") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("__way") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("__way") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return filled.where("__way <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")

