"""Conversation structure repair: the cheapest edits that make roles alternate, by branch and bound.

A conversation is cut into blocks of rows, each reduced to a code a row. A block's suffix bounds need only the cost of
what follows it, by the state in which it is left; those come from the blocks' 4 x 4 cost matrices. So a conversation of
any length is searched block by block, in parallel, and only four numbers a block are walked in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.llm.common import cut, partitions

#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Rows of a block are 2 ** BLOCK_BITS at most.
BLOCK_BITS = 12
#: States: nothing yet, after a system row, after a user, after an assistant. What each may be followed by.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
AFTER = {"u": USER, "a": ASSISTANT}
NAMES = {"u": "user", "a": "assistant"}
#: What ends a conversation costs in each state: a system row still wants both roles, a user an assistant.
ENDS = (0, 2 * INSERT, INSERT, 0)
_WORD = r"[^\x20\x09-\x0D]"

#: An item of a block: the role's initial, or None where the row must go; whether it is truncated; how many equal rows behind it must go.
Item = tuple[str | None, bool, int]


def _steps(item: Item, state: int) -> Iterator[tuple[str, int, int]]:
    """The edits of a row in a state, as (letter, cost, next state), in ASCII order."""
    initial, truncated, extra = item
    gone, extra_cost = ("D" * (extra + 1) if initial is not None else "D" * extra), DELETE * extra
    yield gone, DELETE * len(gone), state
    if initial is not None:
        tail, stays = "D" * extra, extra_cost + (TRUNCATED if truncated else 0)
        if initial == NEXT[state]:
            yield "K" + tail, stays, AFTER[initial]
        elif initial == "s" and state == START:
            yield "K" + tail, stays, SYSTEM
        if initial != NEXT[state]:
            yield "R" + tail, REROLE + stays, AFTER[NEXT[state]]


def bounds(items: list[Item], exits: tuple[float, ...]) -> list[tuple[float, ...]]:
    """For each row and state the least cost of the rest, whatever the audit: the relaxation that bounds a suffix."""
    out = [tuple(exits)]
    for item in reversed(items):
        after = out[-1]
        own = [min(cost + after[to] for _, cost, to in _steps(item, state)) for state in range(4)]
        # One insertion or two may come first.
        once = [min(own[s], INSERT + own[AFTER[NEXT[s]]]) for s in range(4)]
        out.append(tuple(min(once[s], INSERT + once[AFTER[NEXT[s]]]) for s in range(4)))
    return out[::-1]


def matrix(items: list[Item]) -> list[list[float]]:
    """The least cost from each state before a block to each state after it."""
    to = [bounds(items, tuple(0.0 if s == t else float("inf") for s in range(4)))[0] for t in range(4)]
    return [[to[t][s] for t in range(4)] for s in range(4)]


def search(items: list[Item], entry: int, exits: tuple[float, ...] = ENDS, last: bool = True) -> tuple[int, int, list[str], int]:
    """(cost, exit state, the edits of each row and a last entry for insertions at the end, nodes) of the cheapest edits, ASCII-least among equals.

    Depth first over (row, state) with an explicit stack. A branch is cut where its cost and the suffix bound
    exceed the incumbent's, or equal it with a greater audit; and where its node's table holds a prefix
    that costs less, or as much with a smaller audit: two prefixes of one node and cost never begin one another,
    as only insertions lie between them, and these cost, so the smaller one stays smaller. When the
    stack is empty the incumbent is optimal. exits are what follows the block, by state; where the block is the
    conversation's last, insertions may end it.
    """
    rest, n = bounds(items, exits), len(items)
    best: tuple[float, str] | None = None
    end = START
    table: dict[tuple[int, int], tuple[int, str]] = {}
    stack: list[tuple[int, int, int, str]] = [(0, entry, 0, "")]
    nodes = 0
    while stack:
        at, state, cost, audit = stack.pop()
        most = cost + rest[at][state]
        if most == float("inf") or best and (most > best[0] or most == best[0] and audit > best[1][: len(audit)]):
            continue
        seen = table.get((at, state))
        if seen and seen <= (cost, audit):
            continue
        table[at, state] = (cost, audit)
        nodes += 1
        if at == n and (not last or state in (START, ASSISTANT)):
            if best is None or (most, audit) < best:
                best, end = (most, audit), state
            continue
        ways = [] if at == n else [(to, at + 1, paid, letters) for letters, paid, to in _steps(items[at], state)]
        if at < n or last:
            ways.append((AFTER[NEXT[state]], at, INSERT, "I"))
        # The most promising way is taken first, of equal ones the ASCII-least.
        ways.sort(key=lambda w: (w[2] + rest[w[1]][w[0]], w[3]), reverse=True)
        stack += [(where, to, cost + paid, audit + letters) for to, where, paid, letters in ways]
    audit, pieces, pos = best[1], [], 0
    for item in items:
        start = pos
        while audit[pos] == "I":
            pos += 1
        pos += (1 if item[0] is not None else 0) + item[2]
        pieces.append(audit[start:pos])
    return int(best[0] - (exits[end] if not last else 0)), end, [*pieces, audit[pos:]], nodes


def added(piece: str, state: int, initial: str | None) -> tuple[str, str | None, int]:
    """(initials of the inserted rows, the row's new initial or None where it goes, next state) of a row's edits."""
    inserted = ""
    for letter in piece:
        if letter != "I":
            break
        inserted += NEXT[state]
        state = AFTER[inserted[-1]]
    act = piece[len(inserted):][:1]
    if initial is None or act in ("D", ""):
        return inserted, None, state
    new = NEXT[state] if act == "R" else initial
    return inserted, new, SYSTEM if new == "s" else AFTER[new]


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) after damage by the checksum of conv_id and turn; nulls count as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.filter("fault <> 0").select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                                            F.when(F.col("fault") == 3, 2).otherwise(1).cast("long").alias("copies"))


_KEY = ("named", "conv")


def _keyed(rows: DataFrame) -> DataFrame:
    """rows with conv_id as two columns without nulls."""
    return rows.withColumns({"named": F.col("conv_id").isNotNull().cast("int"), "conv": F.coalesce("conv_id", F.lit(0))})


def ordered(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) by conversation and turn, each with its place, its fault and the number of its equals.

    Equal rows become one with their number before anything is dealt out, so that repeats never pile up.
    pos is ascending over all conversations; a block is 2 ** BLOCK_BITS of its values at most. Ties of a
    turn go by role and text. blank, dup and cut count faults; items is what search() wants to know.
    """
    spark = rows.sparkSession
    one = cut(_keyed(rows).groupBy(*_KEY, "turn", "role", "text").agg(F.sum("copies").alias("n")).withColumn("same", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)))
    turn = F.struct(F.col("turn").isNotNull().alias("has"), F.coalesce("turn", F.lit(0)).alias("value"))
    first = one.groupBy(*_KEY, "same").agg(F.min(turn).alias("first"))
    flagged = one.join(first, [*_KEY, "same"]).withColumn("known", F.col("first") < turn).drop("first", "same")
    blank, cut_off = ~F.col("text").rlike(_WORD), ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    seen = flagged.withColumns({
        "blank": F.when(blank, F.col("n")).otherwise(0), "dup": F.when(blank, 0).when(F.col("known"), F.col("n")).otherwise(F.col("n") - 1),
        "cut": F.when(~blank & ~F.col("known") & cut_off, 1).otherwise(0).cast("long"), "goes": blank | F.col("known"), "initial": F.substring("role", 1, 1)})
    # The range of a row is told by the beginning of its text, the order within by all of it.
    keys = [*_KEY, F.col("turn").isNotNull(), "turn", "role"]
    dealt = seen.repartitionByRange(partitions(spark), *keys, F.substring("text", 1, 100)).sortWithinPartitions(*keys, "text")
    return cut(dealt.withColumn("pos", F.monotonically_increasing_id()).withColumn("block", F.shiftright("pos", BLOCK_BITS)))


def blocks(rows: DataFrame) -> DataFrame:
    """ordered() rows as blocks of codes: (named, conv, block, first, last, items)."""
    item = F.struct("pos", "initial", "goes", (F.col("cut") > 0).alias("cut"), "n")
    made = rows.groupBy(*_KEY, "block").agg(F.sort_array(F.collect_list(item)).alias("items"))
    ends = rows.groupBy(*_KEY).agg(F.min("block").alias("low"), F.max("block").alias("high"))
    return cut(made.join(ends, list(_KEY)).select(*_KEY, "block", (F.col("block") == F.col("low")).alias("first"), (F.col("block") == F.col("high")).alias("last"), "items"))


def _items(packed) -> list[Item]:
    return [(None, False, int(r["n"])) if r["goes"] else (r["initial"], bool(r["cut"]), int(r["n"]) - 1) for r in packed]


def _matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"named": batch["named"], "conv": batch["conv"], "block": batch["block"], "costs": [sum(matrix(_items(i)), []) for i in batch["items"]]})


def _exits(group: pd.DataFrame) -> pd.DataFrame:
    """What follows each block of a conversation costs, by state; from its last block backwards."""
    group = group.sort_values("block", ignore_index=True)
    after, out = np.array(ENDS, float), []
    for costs in reversed(group["costs"].tolist()):
        out.append(after.tolist())
        after = (np.array(costs, float).reshape(4, 4) + after).min(1)
    return group[["named", "conv", "block"]].assign(exits=out[::-1])


_SEARCHED = "named int, conv long, block long, entry int, exit int, cost long, illegal long, left string, right string, pos array<long>, piece array<string>, inserted array<string>, role array<string>"


def _illegal(items) -> int:
    """Neighbours within a block, and among a row's equals, whose initials may not follow one another."""
    names, times = [r["initial"] for r in items], [int(r["n"]) for r in items]
    return sum(t - 1 for t in times) + sum(a + b not in ("su", "ua", "au") for a, b in zip(names, names[1:], strict=False))


def _searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            items, packed, last = _items(row.items), list(row.items), bool(row.last)
            for entry in (START,) if row.first else range(4):
                exits = ENDS if last else tuple(row.exits)
                cost, end, pieces, _ = search(items, entry, exits, last)
                state, inserted, roles = entry, [], []
                for piece, item in zip(pieces, [*items, (None, False, 0)], strict=True):
                    new, role, state = added(piece, state, item[0])
                    inserted.append(new)
                    roles.append(role)
                out.append((row.named, row.conv, row.block, entry, end, cost, _illegal(packed), packed[0]["initial"], packed[-1]["initial"],
                            [r["pos"] for r in packed] + [packed[-1]["pos"]], pieces, inserted, roles))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _SEARCHED.split(", ")])


def _chained(group: pd.DataFrame) -> pd.DataFrame:
    """Of each block of a conversation the entry that the block before it leaves."""
    ways = {(b, e): x for b, e, x in zip(group["block"], group["entry"], group["exit"], strict=True)}
    state, out = START, []
    for block in sorted(set(group["block"])):
        out.append((group["named"].iloc[0], group["conv"].iloc[0], block, state))
        state = ways[block, state]
    return pd.DataFrame(out, columns=["named", "conv", "block", "entry"])


def solved(made: DataFrame) -> DataFrame:
    """The chosen edits of each block: a row of _SEARCHED for each row of blocks()."""
    several = made.filter("not (first and last)")
    exits = several.select(*_KEY, "block", "items").mapInPandas(_matrices, "named int, conv long, block long, costs array<double>").groupBy(*_KEY).applyInPandas(_exits, "named int, conv long, block long, exits array<double>")
    found = cut(made.join(exits, [*_KEY, "block"], "left").select(*_KEY, "block", "first", "last", "items", "exits").mapInPandas(_searched, _SEARCHED))
    parts = several.select(*_KEY, "block")
    chosen = found.select(*_KEY, "block", "entry", "exit").join(parts, [*_KEY, "block"], "left_semi").groupBy(*_KEY).applyInPandas(_chained, "named int, conv long, block long, entry int")
    alone = found.join(parts, [*_KEY, "block"], "left_anti")
    return cut(alone.unionByName(found.join(chosen, [*_KEY, "block", "entry"], "left_semi")))


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(named, conv, pos, tail, role, text, insertions): the rows that stay, with their roles; insertions are those before each.

    A row that goes still carries the insertions before it, with a null role; what is inserted at the end of a
    conversation comes with tail = 1.
    """
    each = found.select(*_KEY, F.posexplode(F.arrays_zip("pos", "inserted", F.col("role").alias("new")))).select(*_KEY, "pos", "col").select(
        *_KEY, F.col("col.pos").alias("place"), F.col("pos").alias("at"), F.col("col.inserted").alias("inserted"), F.col("col.new").alias("new"))
    last = F.row_number().over(Window.partitionBy(*_KEY, "place").orderBy("at"))
    each = each.withColumn("tail", last - 1).drop("at")
    name = F.when(F.col("new") == "s", F.col("role")).when(F.col("new") == F.col("initial"), F.col("role")).when(F.col("new") == "u", NAMES["u"]).when(F.col("new") == "a", NAMES["a"])
    joined = each.join(rows.select(*_KEY, F.col("pos").alias("place"), "role", "initial", "text"), [*_KEY, "place"])
    return joined.select(*_KEY, F.col("place").alias("pos"), "tail", name.alias("role"), F.when(name.isNotNull(), F.col("text")).alias("text"), "inserted").filter("role is not null or inserted <> ''")


def _lines() -> Column:
    """A repaired row and the insertions before it, as role:text joined by newlines."""
    made = F.transform(F.split(F.col("inserted"), ""), lambda c: F.when(c == "u", F.lit("user:")).when(c == "a", F.lit("assistant:")))
    return F.array_join(F.concat(F.filter(made, lambda x: x.isNotNull()), F.when(F.col("role").isNotNull(), F.array(F.concat("role", F.lit(":"), "text"))).otherwise(F.array())), "\n")


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One hash a conversation over its rows, which come in order: a stream, of which only the hash is held."""
    at, made = None, None
    for batch in batches:
        out = []
        for named, conv, line in zip(batch["named"].tolist(), batch["conv"].tolist(), batch["line"], strict=True):
            if (named, conv) != at:
                if at:
                    out.append((*at, made.hexdigest()))
                at, made = (named, conv), hashlib.sha256()
            else:
                made.update(b"\n")
            made.update(line.encode("utf-8", "replace"))
        yield pd.DataFrame(out, columns=["named", "conv", "sha"])
    if at:
        yield pd.DataFrame([(*at, made.hexdigest())], columns=["named", "conv", "sha"])


def op12_repair(conversations: DataFrame) -> DataFrame:
    """Faults, cost, audit and digest of each damaged conversation after repair; a row for each conv_id, null included.

    Null turns come first, rows of one turn go by role and text, equal rows count each for itself. A role of no
    letters cannot be kept. Very long texts are never gathered: a conversation's rows meet as codes, in blocks;
    only its audit (a letter an edit) and the stream that its digest is made from are whole. A conversation
    that loses all rows has zeros, an empty audit and the digest of nothing. An empty table gives an
    empty result; other columns are not looked at.
    """
    spark = conversations.sparkSession
    rows = ordered(damaged(conversations))
    found = solved(blocks(rows))
    counts = rows.groupBy(*_KEY).agg(*[F.sum(c).alias(c) for c in ("blank", "dup", "cut")], F.min("turn").alias("low"), F.max("turn").alias("high"), F.countDistinct("turn").alias("turns"))
    ahead = Window.partitionBy(*_KEY).orderBy("block")
    crossing = F.lag("right").over(ahead)
    edits = found.select(*_KEY, "block", "cost", "illegal", "left", "right", F.array_join("piece", "").alias("audit")).withColumn(
        "across", (crossing.isNotNull() & ~F.concat(crossing, F.col("left")).isin("su", "ua", "au")).cast("long"))
    totals = edits.groupBy(*_KEY).agg(F.sum("cost").alias("cost"), (F.sum("illegal") + F.sum("across")).alias("illegal"),
                                      F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    lines = repaired(rows, found).select(*_KEY, "pos", "tail", _lines().alias("line"))
    digests = lines.repartition(partitions(spark), *_KEY).sortWithinPartitions(*_KEY, "pos", "tail").select(*_KEY, "line").mapInPandas(_digests, "named int, conv long, sha string")
    every = _keyed(conversations.select(F.col("conv_id").cast("long").alias("conv_id"))).select(*_KEY, "conv_id").distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = every.join(counts, list(_KEY), "left").join(totals, list(_KEY), "left").join(digests, list(_KEY), "left")
    return out.select("conv_id", zero(F.col("high") - F.col("low") + 1 - F.col("turns")).alias("gaps"), zero(F.col("blank")).alias("blank"), zero(F.col("dup")).alias("duplicate"), zero(F.col("cut")).alias("truncated"),
                      zero(F.col("illegal")).alias("illegal"), zero(F.col("cost")).alias("cost"), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
