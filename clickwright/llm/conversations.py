"""Repair of conversations whose roles do not fit a role grammar, by generalised LR parsing with weighted edits.

``RoleGrammar`` builds the LR automaton of a grammar over role initials.  A parse keeps a graph-structured stack: stacks that agree share
their nodes, and where several edits lead to the same top, only the one of smallest (cost, audit) goes on.  Each row of a conversation is kept,
given another role or deleted, and turns without text may be inserted anywhere; the audit is the list of these actions.  Audits of one row
number are prefix-free (each ends in the action on that row), so it is enough to know their order: tops carry (cost, rank), not strings.

Rows are sorted by conversation and turn into range partitions and cut into blocks of at most ``BLOCK_ROWS`` rows, so a conversation may
span any number of tasks.  A conversation that is one block is repaired where it was read.  For the others each block gives a small table, the
best (cost, rank) from each stack top to each, and tables of neighbouring blocks are combined ``FAN`` at a time in rounds, up to one table and
down again to the tops between blocks.  Then each block is repaired by itself, and one pass over the blocks in order joins the audits and hashes the
text, holding a block at a time.  The hash and the audit of one conversation are one row, as large as the result has to be.

Faults: blank (no visible character), duplicate (role and text seen earlier in the conversation), truncated (the last visible character ends no
sentence); the first that fits counts.  Blank and duplicate rows must go.

Defined results: a null role or text reads as one space, an empty role has an initial that fits nowhere; null turns come first; rows of one turn are
ordered by role, then text; a null conv_id is a conversation of its own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickwright.llm.common import WHITE, settle, ship, shuffle_partitions
from clickwright.plans.ordered import global_rank

NAMES = {"u": "user", "a": "assistant"}
RULES = (("S", ""), ("S", "P"), ("S", "sP"), ("P", "ua"), ("P", "Pua"))
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
BLOCK_ROWS, BLOCK_CHARS, FAN = 4096, 1 << 20, 64
NONE = 1 << 60
FAULTS = ("none", "blank", "duplicate", "truncated")


class RoleGrammar:
    """LR automaton of a grammar; upper-case letters are nonterminals, the first rule's is the start."""

    def __init__(self, rules: tuple[tuple[str, str], ...] = RULES, limit: int = 256) -> None:
        self.rules = (("", rules[0][0]), *rules)
        self.states: list[frozenset] = [self._closure({(0, 0)})]
        self.terminals = sorted({c for _, r in rules for c in r if not c.isupper()})
        self.follow = self._follow()
        #: nodes of the graph-structured stack: (state, node below)
        self.nodes: list[tuple[int, int]] = [(0, -1)]
        self._node = {(0, -1): 0}
        self.shifts: dict[tuple[int, str], list[int]] = {}
        at = 0
        while at < len(self.nodes):
            for c in self.terminals:
                self.shifts[at, c] = self._shift(at, c)
            at += 1
            if len(self.nodes) > limit:
                raise ValueError("the grammar's stacks are not bounded: write its repetition left-recursively")
        #: nodes that can be on top behind a role, and the start
        self.tops = sorted({0}.union(*self.shifts.values()))
        self.accepting = [i for i in self.tops if any((0, 1) in self.states[self.nodes[j][0]] for j in self._reduced(i, "$"))]

    def _closure(self, items: set) -> frozenset:
        todo, done = list(items), set(items)
        while todo:
            rule, dot = todo.pop()
            right = self.rules[rule][1]
            for i, (left, _) in enumerate(self.rules):
                if dot < len(right) and left == right[dot] and (i, 0) not in done:
                    done.add((i, 0))
                    todo.append((i, 0))
        return frozenset(done)

    def _goto(self, state: int, symbol: str) -> int | None:
        moved = {(r, d + 1) for r, d in self.states[state] if self.rules[r][1][d : d + 1] == symbol}
        if not moved:
            return None
        found = self._closure(moved)
        if found not in self.states:
            self.states.append(found)
        return self.states.index(found)

    def _follow(self) -> dict[str, set[str]]:
        empty, first, changed = set(), {}, True
        while changed:
            changed = False
            for left, right in self.rules:
                mine = first.setdefault(left, set())
                was = len(mine), left in empty
                for c in right:
                    mine |= first.get(c, set()) if c.isupper() else {c}
                    if c not in empty:
                        break
                else:
                    empty.add(left)
                changed |= was != (len(mine), left in empty)
        follow, changed = {left: {"$"} if left == self.rules[0][1] else set() for left, _ in self.rules}, True
        while changed:
            changed = False
            for left, right in self.rules:
                after = follow[left] | ({"$"} if not left else set())
                for c in reversed(right):
                    if c.isupper():
                        changed |= not after <= follow[c]
                        follow[c] |= after
                        after = first[c] | (after if c in empty else set())
                    else:
                        after = {c}
        return follow

    def _push(self, state: int, below: int) -> int:
        key = (state, below)
        if key not in self._node:
            self._node[key] = len(self.nodes)
            self.nodes.append(key)
        return self._node[key]

    def _reduced(self, node: int, ahead: str) -> list[int]:
        """The node and all that reductions make of it before the symbol ahead."""
        todo, seen = [node], {node}
        while todo:
            at = todo.pop()
            for rule, dot in self.states[self.nodes[at][0]]:
                left, right = self.rules[rule]
                if rule and dot == len(right) and ahead in self.follow[left]:
                    under = at
                    for _ in right:
                        under = self.nodes[under][1]
                    new = self._push(self._goto(self.nodes[under][0], left), under)
                    if new not in seen:
                        seen.add(new)
                        todo.append(new)
        return sorted(seen)

    def _shift(self, node: int, symbol: str) -> list[int]:
        to = [(self._goto(self.nodes[n][0], symbol), n) for n in self._reduced(node, symbol)]
        return [self._push(state, n) for state, n in to if state is not None]


@cache
def grammar() -> RoleGrammar:
    return RoleGrammar()


@cache
def inserted(node: int) -> tuple[tuple[int, str], ...]:
    """(node, roles) that the fewest insertions reach from a node, itself first."""
    g, found, todo = grammar(), {node: ""}, [node]
    for at in todo:
        for c in NAMES:
            for to in g.shifts[at, c]:
                if to not in found:
                    found[to] = found[at] + c
                    todo.append(to)
    return tuple(found.items())


@cache
def actions(initial: str, fault: int) -> tuple[tuple[tuple[int, int, str, str], ...], ...]:
    """For each stack top the best action on a row to each top after it: (top, cost, audit, roles).

    Roles: what each letter of the audit makes: an inserted or new role, ``-`` for a kept row and ``x`` for one that goes.
    """
    g, more = grammar(), TRUNCATED if FAULTS[fault] == "truncated" else 0
    table = []
    for node in range(len(g.nodes)):
        best: dict[int, tuple] = {}
        for at, roles in inserted(node) if node in g.tops else ():
            marks, base = "I" * len(roles), INSERT * len(roles)
            options = [(at, base + DELETE, marks + "D", roles + "x")]
            if FAULTS[fault] not in ("blank", "duplicate"):
                options += [(to, base + KEEP + more, marks + "K", roles + "-") for to in g.shifts.get((at, initial), [])]
                options += [(to, base + REROLE + more, marks + "R", roles + c) for c in NAMES if c != initial for to in g.shifts[at, c]]
            for to, *rest in options:
                if to not in best or rest < list(best[to][1:]):
                    best[to] = (to, *rest)
        table.append(tuple(best.values()))
    return tuple(table)


def forward(rows: list[tuple], start: int) -> tuple[dict[int, tuple[int, int]], list[dict]]:
    """Live tops with (cost, rank) after the rows, and for each row how each top was reached.  rows: (role, text, initial, fault)."""
    live, trail = {start: (0, 0)}, []
    for _, _, initial, fault in rows:
        table, best = actions(initial, fault), {}
        for top, (cost, rank) in live.items():
            for to, more, audit, roles in table[top]:
                way = (cost + more, rank, audit, top, roles)
                if to not in best or way[:3] < best[to][:3]:
                    best[to] = way
        order = {key: i for i, key in enumerate(sorted({w[1:3] for w in best.values()}))}
        trail.append(best)
        live = {to: (w[0], order[w[1:3]]) for to, w in best.items()}
    return live, trail


def ending(live: dict[int, tuple[int, int]]) -> tuple[int, int, str]:
    """(cost, top, inserted roles) of the cheapest way to a whole conversation."""
    goal = set(grammar().accepting)
    ways = [(cost + INSERT * len(roles), rank, top, roles) for top, (cost, rank) in live.items() for to, roles in inserted(top) if to in goal]
    cost, _, top, roles = min(ways)
    return cost, top, roles


def repaired(rows: list[tuple], trail: list[dict], top: int, more: str = "") -> tuple[str, list[str]]:
    """(audit, lines) of the way that ends in ``top``, with the roles in ``more`` inserted behind it."""
    steps = []
    for best in reversed(trail):
        _, _, audit, before, roles = best[top]
        steps.append((audit, roles))
        top = before
    lines = []
    for (role, text, _, _), (_, roles) in zip(rows, reversed(steps)):
        lines += [f"{NAMES[c]}:" for c in roles[:-1]]
        if roles[-1] != "x":
            lines.append(f"{role if roles[-1] == '-' else NAMES[roles[-1]]}:{text}")
    return "".join(a for a, _ in reversed(steps)) + "I" * len(more), lines + [f"{NAMES[c]}:" for c in more]


def joined(a: dict, b: dict) -> dict:
    """Summary of two neighbouring runs of rows."""
    out = {k: a[k] + b[k] for k in ("n", "blank", "duplicate", "truncated")}
    meets = a["hi"] is not None and a["hi"] == b["lo"]
    out["turns"] = a["turns"] + b["turns"] - meets
    out["lo"] = a["lo"] if a["lo"] is not None else b["lo"]
    out["hi"] = b["hi"] if b["hi"] is not None else a["hi"]
    out["illegal"] = a["illegal"] + b["illegal"] + (a["last"] + b["first"] not in ("su", "ua", "au"))
    out["first"], out["last"] = a["first"], b["last"]
    size = len(grammar().nodes)
    cost, rank = [], []
    for s in range(size):
        live = {t: (a["cost"][s * size + t], a["rank"][s * size + t]) for t in range(size) if a["cost"][s * size + t] < NONE}
        after = across(live, b)
        cost += [after[t][0] if t in after else NONE for t in range(size)]
        rank += [after[t][1] if t in after else 0 for t in range(size)]
    return out | {"cost": cost, "rank": rank}


def _ways(live: dict[int, tuple[int, int]], b: dict) -> dict[int, tuple]:
    size, best = len(grammar().nodes), {}
    for top, (cost, rank) in live.items():
        for to in range(size):
            at = top * size + to
            if b["cost"][at] < NONE:
                way = (cost + b["cost"][at], rank, b["rank"][at], top)
                if to not in best or way[:3] < best[to][:3]:
                    best[to] = way
    return best


def across(live: dict[int, tuple[int, int]], b: dict) -> dict[int, tuple[int, int]]:
    """Live tops after a run of rows, from its summary."""
    best = _ways(live, b)
    order = {key: i for i, key in enumerate(sorted({w[1:3] for w in best.values()}))}
    return {to: (w[0], order[w[1:3]]) for to, w in best.items()}


def counts(rows: list[tuple], turns: list[int | None]) -> dict:
    told = [t for t in turns if t is not None]
    initials, faults = [r[2] for r in rows], [r[3] for r in rows]
    return {
        "n": len(rows),
        **{f: faults.count(i) for i, f in enumerate(FAULTS) if i},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "turns": len(set(told)),
        "lo": told[0] if told else None,
        "hi": told[-1] if told else None,
        "first": initials[0],
        "last": initials[-1],
    }


def tops(rows: list[tuple]) -> dict:
    """Best (cost, rank) from each top before the rows to each top behind them."""
    size, cost, rank = len(grammar().nodes), [], []
    for s in range(size):
        live = forward(rows, s)[0] if s in grammar().tops else {}
        cost += [live[t][0] if t in live else NONE for t in range(size)]
        rank += [live[t][1] if t in live else 0 for t in range(size)]
    return {"cost": cost, "rank": rank}


def whole(rows: list[tuple]) -> dict:
    """The repair of a conversation that is these rows."""
    live, trail = forward(rows, 0)
    cost, top, more = ending(live)
    audit, lines = repaired(rows, trail, top, more)
    return {"whole_cost": cost, "audit": audit, "sha": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


def faulty(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, uid) with the fault of each row and its role's initial."""
    digest = F.sha2("text", 256)
    first = rows.groupBy("conv_id", "role", digest.alias("digest")).agg(F.min(F.struct(F.col("turn").isNotNull().alias("told"), "turn", "uid")).alias("f"))
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("f.uid").alias("first_uid"))
    rows = rows.withColumn("digest", digest)
    rows = rows.join(first, rows["conv_id"].eqNullSafe(first["c"]) & (rows["role"] == first["r"]) & (rows["digest"] == first["d"]))
    bare = F.rtrim("text", F.lit(WHITE))
    fault = F.when(bare == "", 1).when(F.col("uid") != F.col("first_uid"), 2).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    return rows.select("conv_id", "turn", "role", "text", "uid", fault.alias("fault"), F.substring(F.concat("role", F.lit(" ")), 1, 1).alias("initial"))


def conversation_rows(table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text of a table, null roles and texts as one space."""
    told = lambda c: F.coalesce(table[c].cast("string"), F.lit(" "))
    return table.select(table[conv_col].alias("conv_id"), table[turn_col].cast("long").alias("turn"), told(role_col).alias("role"), told(text_col).alias("text"))


def check_sum(rows: DataFrame) -> Column:
    told = [F.coalesce(rows[c].cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    return F.crc32(F.concat_ws(":", *told))


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with every fifth or so damaged by check sum: dropped, emptied, without sentence ends, repeated, or given the role user."""
    kind = check_sum(rows) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


ROW = ("role", "text", "initial", "fault")
_ITEM = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("initial", pa.string()), ("fault", pa.int32())]))
_SUMMARY = {c: pa.int64() for c in ("block", "n", "blank", "duplicate", "truncated", "illegal", "turns", "lo", "hi")}
_SUMMARY |= {"first": pa.string(), "last": pa.string(), "cost": pa.list_(pa.int64()), "rank": pa.list_(pa.int64())}
_BLOCK = _SUMMARY | {"whole_cost": pa.int64(), "audit": pa.string(), "sha": pa.string(), "items": _ITEM}
_SPAN = {"block": pa.int64(), "at": pa.int64(), "start": pa.int32(), "top": pa.int32(), "more": pa.string()}
_NAMES = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.list_(pa.int64()): "array<long>"}
_NAMES[_ITEM] = "array<struct<role:string,text:string,initial:string,fault:int>>"


def _ddl(conv_type: str, kinds: dict) -> str:
    return ", ".join([f"conv_id {conv_type}", *[f"{c} {_NAMES[t]}" for c, t in kinds.items()]])


def _table(rows: list[dict], conv_type: pa.DataType, kinds: dict) -> pa.Table:
    return pa.table({c: pa.array([r.get(c) for r in rows], t) for c, t in ({"conv_id": conv_type} | kinds).items()})


def blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One written row per block.  A conversation that was seen to begin and end in one block is repaired; other blocks hold their rows."""
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    ordered = rows.orderBy(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "uid").drop("uid")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, turns, chars, conv, kind = TaskContext.get().partitionId() << 32, [], [], 0, None, None
        begun, out = False, []  # begun: the conversation began in this task and in this block

        def close(ended: bool) -> None:
            nonlocal block, held, turns, chars
            more = whole(held) if begun and ended else tops(held) | {"items": [dict(zip(ROW, r)) for r in held]}
            out.append({"conv_id": conv, "block": block} | counts(held, turns) | more)
            block, held, turns, chars = block + 1, [], [], 0

        for b in batches:
            kind = b.schema.field(0).type
            for c, turn, role, text, fault, initial in zip(*(b.column(i).to_pylist() for i in range(6))):
                if held and c != conv:
                    close(True)
                    begun = True
                elif held and (len(held) >= block_rows or chars >= BLOCK_CHARS):
                    close(False)
                    begun = False
                conv = c
                held.append((role, text, initial, fault))
                turns.append(turn)
                chars += len(text)
            yield from _table(out, kind, _BLOCK).to_batches()
            out.clear()
        if held:
            close(False)
            yield from _table(out, kind, _BLOCK).to_batches()

    return settle(ordered.mapInArrow(cut, _ddl(conv_type, _BLOCK)), "conversation-blocks")


def _folded(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["at"])
    out = rows[0]
    for r in rows[1:]:
        out = joined(out, r) | {"conv_id": out["conv_id"], "block": out["block"], "at": out["at"]}
    return _table([out | {"at": out["at"] // FAN}], table.schema.field("conv_id").type, _SUMMARY | {"at": pa.int64()})


def _spread(table: pa.Table) -> pa.Table:
    """The tops around each run of a group, from the tops around the group (the row without a table)."""
    rows = sorted((r for r in table.to_pylist()), key=lambda r: (r["cost"] is not None, r["at"]))
    group, runs = rows[0], rows[1:]
    live, trail = {group["start"]: (0, 0)}, []
    for r in runs:
        trail.append(_ways(live, r))
        live = across(live, r)
    top, out = group["top"], []
    for r, best in zip(reversed(runs), reversed(trail)):
        before = best[top][3]
        out.append({"conv_id": r["conv_id"], "block": r["block"], "at": r["at"], "start": before, "top": top, "more": "" if out else group["more"]})
        top = before
    return _table(out, table.schema.field("conv_id").type, _SPAN)


def _long_conversations(found: DataFrame) -> DataFrame:
    """Results of the conversations whose blocks hold their rows: conv_id, counts, whole_cost, audit, sha."""
    spark, conv_type = found.sparkSession, found.schema["conv_id"].dataType.simpleString()
    open_blocks = found.where("items IS NOT NULL")
    level = settle(global_rank(open_blocks.select("conv_id", *_SUMMARY), ["block"], "at"), "conversation-tops")
    levels, schema = [level], _ddl(conv_type, _SUMMARY | {"at": pa.int64()})
    while not levels[-1].groupBy("conv_id").count().where("count > 1").isEmpty():
        group = F.floor(F.col("at") / FAN).alias("group")
        levels.append(settle(levels[-1].groupBy("conv_id", group).applyInArrow(_folded, schema), "conversation-tops"))

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            for r in rows:
                r["whole_cost"], r["top"], r["more"] = ending(across({0: (0, 0)}, r))
                r["start"] = 0
            yield from _table(rows, b.schema.field("conv_id").type, _SUMMARY | _SPAN | {"whole_cost": pa.int64()}).to_batches()

    ends = settle(levels[-1].mapInArrow(ended, _ddl(conv_type, _SUMMARY | _SPAN | {"whole_cost": pa.int64()})), "conversation-ends")
    spans = ends.select("conv_id", *_SPAN)
    for level in reversed(levels[:-1]):
        runs = level.select("conv_id", "block", F.floor(F.col("at") / FAN).alias("group"), "at", "cost", "rank")
        groups = spans.withColumnRenamed("at", "group").withColumn("at", F.lit(-1).cast("long"))
        both = runs.unionByName(groups, allowMissingColumns=True)
        spans = settle(both.groupBy("conv_id", "group").applyInArrow(_spread, _ddl(conv_type, _SPAN)), "conversation-spans")

    def mended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                rows = [tuple(x[c] for c in ROW) for x in r["items"]]
                audit, lines = repaired(rows, forward(rows, r["start"])[1], r["top"], r["more"])
                out.append({"conv_id": r["conv_id"], "block": r["block"], "audit": audit, "text": "\n".join(lines) if lines else None})
            yield from _table(out, b.schema.field("conv_id").type, piece).to_batches()

    def strung(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audits, digest, any_line, kind = None, [], None, False, None
        for b in batches:
            kind, out = b.schema.field(0).type, []
            for r in b.to_pylist():
                if digest is None or r["conv_id"] != conv:
                    if digest is not None:
                        out.append({"conv_id": conv, "audit": "".join(audits), "sha": digest.hexdigest()})
                    conv, audits, digest, any_line = r["conv_id"], [], hashlib.sha256(), False
                audits.append(r["audit"])
                if r["text"] is not None:
                    digest.update((("\n" if any_line else "") + r["text"]).encode())
                    any_line = True
            yield from _table(out, kind, done).to_batches()
        if digest is not None:
            yield from _table([{"conv_id": conv, "audit": "".join(audits), "sha": digest.hexdigest()}], kind, done).to_batches()

    piece = {"block": pa.int64(), "audit": pa.string(), "text": pa.string()}
    done = {"audit": pa.string(), "sha": pa.string()}
    joined_blocks = open_blocks.select("conv_id", "block", "items").join(spans.select("block", "start", "top", "more"), "block")
    pieces = settle(joined_blocks.select("conv_id", "block", "items", "start", "top", "more").mapInArrow(mended, _ddl(conv_type, piece)), "conversation-pieces")
    strings = pieces.repartition(shuffle_partitions(spark), "conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(strung, _ddl(conv_type, done))
    strings = strings.withColumnRenamed("conv_id", "c")
    return ends.join(strings, ends["conv_id"].eqNullSafe(strings["c"])).drop("c")


def repair_conversations(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per conversation of ``rows`` (see ``conversation_rows``): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    ship(rows.sparkSession)
    numbered = settle(rows.withColumn("uid", F.monotonically_increasing_id()), "conversation-rows")
    found = blocks(faulty(numbered), block_rows)
    names = ["conv_id", "turns", "lo", "hi", *FAULTS[1:], "illegal", "whole_cost", "audit", "sha"]
    short = found.where("items IS NULL").select(*names)
    both = short.unionByName(_long_conversations(found).select(*names))
    gaps = F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("turns"), F.lit(0)).cast("long")
    return both.select("conv_id", gaps.alias("gaps"), *FAULTS[1:], "illegal", F.col("whole_cost").alias("cost"), "audit", F.col("sha").alias("repaired_sha256"))


def repair_all(rows: DataFrame, originals: DataFrame, **how) -> DataFrame:
    """``repair_conversations`` for each conv_id of ``originals``; one without rows has zeros, an empty audit and the hash of an empty text."""
    found = repair_conversations(rows, **how)
    found = found.select(F.col("conv_id").alias("c"), *found.columns[1:])
    every = originals.select("conv_id").distinct()
    out = every.join(found, every["conv_id"].eqNullSafe(found["c"]), "left").drop("c")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *FAULTS[1:], "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
