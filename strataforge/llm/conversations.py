"""Repair of a conversation's structure: the cheapest edits that make its roles read system? (user assistant)*.

Edits, by initials: K keeps a row (0), R gives it the role that is due (3), D deletes it (4, and the only choice for blank rows and
repeats), I inserts an empty row of the due role (3); a row cut off in mid-sentence that stays costs 3 more. Of the cheapest
edits, the ones whose initials come first in ASCII order are taken. The roles read so far decide which role is due, so the initials say
everything.

The search goes depth first over nodes (rows done, state of the roles) with a stack of its own. A lower bound of each rest counts what
every row must cost and, over disjoint neighbours whose roles can't stand next to each other, what parting them must cost. A branch ends
where its cost and bound exceed the incumbent, where they equal it but the initials are already behind, or where the table of its node has a prefix as good: of two prefixes that meet
at one node, equal in cost, neither begins with the other (that would need inserts, which cost), so the smaller stays the smaller. The search ends when
the stack is empty, which proves the incumbent.

Conversations are dealt by their key and sorted by turn, and pass through a task as a stream: blocks of at most BLOCK rows are searched from
each state that the rows before can end in, and each such end carries its cost, its initials and its own running SHA-256. So a task
holds a block of texts and one byte a row, however long a conversation is; the checksum is what binds a conversation to one task. Repeats are found
before by a window over conversation, role and text, so no set of seen texts is held.

Defined cases: null roles and texts are one space (such a text is blank); rows without a turn come first, equal turns are ordered by role and text; rows of a
null key are one conversation; repeated rows are repeats; texts of any length count by their last character; an empty table gives no conversation;
columns other than the four named ones are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

SPACE = " \t\n\x0b\x0c\r"
ROLES = ("user", "assistant")
#: States of the roles read so far: none, system, user, assistant. What may follow, and where that leads.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
DUE = (2, 2, 3, 2)
BLOCK, BLOCK_BYTES = 64, 16 << 20
KEEP, RENAME, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3


@dataclass(frozen=True)
class Row:
    role: str
    text: str
    gone: bool
    cut_off: bool


@dataclass
class End:
    """The best way to a state: cost, initials, checksum so far, and whether it has any row."""

    cost: int = 0
    audit: str = ""
    digest: object = field(default_factory=hashlib.sha256)
    any: bool = False


def bounds(rows: list[Row], last: bool) -> list[list[int]]:
    """For each number of rows done and each state: what the rest must cost at least.

    A row that can't keep its role (after the beginning, a system's as well) is renamed or deleted. Neighbours that can't stand next to each other are parted by
    an edit of one of them or between them; disjoint pairs need edits of their own. At the beginning one step is looked ahead.
    """
    n = len(rows)
    usable = [not r.gone and r.role[:1] in ("u", "a") for r in rows]
    own = [DELETE if r.gone else CUT_OFF * r.cut_off if usable[k] else min(DELETE, RENAME + CUT_OFF * r.cut_off) for k, r in enumerate(rows)]
    stay = [k for k in range(n) if not rows[k].gone]

    def part(*ks: int) -> int:
        """What parting these rows costs beyond what they cost anyway."""
        return DELETE - CUT_OFF if any(rows[k].cut_off for k in ks) else min(DELETE, RENAME, INSERT)

    apart = [0] * (len(stay) + 2)  # of rows that stay, from the k-th on
    for k in range(len(stay) - 1, -1, -1):
        row, apart[k] = stay[k], apart[k + 1]
        if not usable[row]:
            continue
        if k + 1 < len(stay):
            if usable[stay[k + 1]] and rows[row].role[:1] == rows[stay[k + 1]].role[:1]:
                apart[k] = max(apart[k], part(row, stay[k + 1]) + apart[k + 2])
        elif last and rows[row].role[:1] != "a":
            apart[k] = max(apart[k], part(row))
    out, forced, k = [[0] * 4 for _ in range(n + 1)], 0, len(stay)
    for i in range(n, -1, -1):
        if i < n:
            forced += own[i]
            k -= not rows[i].gone
        for state in (1, 2, 3):
            more = apart[k]
            if k == len(stay):
                more = INSERT if last and state != 3 else 0
            elif usable[stay[k]] and rows[stay[k]].role[:1] not in NEXT[state]:
                more = max(more, part(stay[k]) + apart[k + 1])
            out[i][state] = forced + more
        ahead = [INSERT + out[i][2]]
        if i == n:
            ahead.append(0)
        else:
            ahead.append(DELETE + out[i + 1][0])
            if not rows[i].gone:
                stays, to = CUT_OFF * rows[i].cut_off, NEXT[0].get(rows[i].role[:1])
                ahead += [stays + RENAME + out[i + 1][2], *([] if to is None else [stays + out[i + 1][to]])]
        out[i][0] = min(ahead)
    return out


def search(rows: list[Row], start: int, last: bool, count: list[int] | None = None) -> dict[int, tuple[int, str]]:
    """The cheapest (cost, initials) from a state through all rows, by the state at their end; if these are the last rows, of the accepted states' best alone."""
    n, least = len(rows), bounds(rows, last)
    table: list[dict[int, tuple[int, str]]] = [{} for _ in range(n + 1)]
    best: dict[int, tuple[int, str]] = {}
    stack = [(0, start, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        known = table[i].get(state)
        if known is not None and known <= (cost, audit):
            continue
        if best and (last or len(best) == 4):
            bound = cost + least[i][state]
            if all(bound > c or (bound == c and audit > a[: len(audit)]) for c, a in best.values()):
                continue
        table[i][state] = (cost, audit)
        if count is not None:
            count[0] += 1
        if i == n and (not last or state in (0, 3)):
            key = 0 if last else state
            if key not in best or (cost, audit) < best[key]:
                best[key] = (cost, audit)
        moves = []
        if i < n or last:
            moves.append((i, DUE[state], cost + INSERT, audit + "I"))
        if i < n:
            row = rows[i]
            moves.append((i + 1, state, cost + DELETE, audit + "D"))
            if not row.gone:
                stays = cost + (CUT_OFF if row.cut_off else 0)
                to = NEXT[state].get(row.role[:1])
                if to is not None:
                    moves.append((i + 1, to, stays + KEEP, audit + "K"))
                moves.append((i + 1, DUE[state], stays + RENAME, audit + "R"))
        moves.sort(key=lambda m: (m[2] + least[m[0]][m[1]], m[3]), reverse=True)
        stack += moves  # the most promising is taken next
    return best


def apply(end: End, start: int, rows: list[Row], audit: str) -> End:
    """`end` carried on through the rows as the initials say."""
    out, state, at = End(end.cost, end.audit + audit, end.digest.copy(), end.any), start, 0
    for letter in audit:
        if letter != "I":
            row, at = rows[at], at + 1
        if letter == "D":
            continue
        to = NEXT[state][row.role[:1]] if letter == "K" else DUE[state]
        role, text = (row.role, row.text) if letter == "K" else (ROLES[to - 2], "" if letter == "I" else row.text)
        out.digest.update((("\n" if out.any else "") + role + ":").encode(errors="replace") + text.encode(errors="replace"))
        out.any, state = True, to
    return out


class Repair:
    """One conversation, row by row."""

    def __init__(self, block: int = BLOCK):
        self.block, self.rows, self.size = block, [], 0
        self.ends: dict[int, End] = {0: End()}
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.first = self.turn = self.initial = None
        self.turns = 0

    def add(self, turn, role: str, text: str, repeat: bool) -> None:
        if len(self.rows) >= self.block or self.size >= BLOCK_BYTES:
            self._close(last=False)
        if turn is not None and turn != self.turn:
            self.first, self.turn, self.turns = turn if self.turns == 0 else self.first, turn, self.turns + 1
        bare = text.rstrip(SPACE)
        fault = "blank" if not bare else "duplicate" if repeat else "truncated" if bare[-1] not in ".!?" else None
        if fault:
            self.counts[fault] += 1
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.initial = role[:1]
        self.rows.append(Row(role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        self.size += len(text)

    def _close(self, last: bool) -> None:
        found: dict[int, tuple[int, str, int, str]] = {}
        for state, end in self.ends.items():
            for to, (cost, audit) in search(self.rows, state, last).items():
                way = (end.cost + cost, end.audit + audit, state, audit)
                if to not in found or way[:2] < found[to][:2]:
                    found[to] = way
        ends = {}
        for to, (cost, _, state, audit) in found.items():
            ends[to] = apply(self.ends[state], state, self.rows, audit)
            ends[to].cost = cost
        self.ends, self.rows, self.size = ends, [], 0

    def result(self) -> list:
        """gaps, blank, duplicate, truncated, illegal, cost, initials, SHA-256 of the repaired rows."""
        self._close(last=True)
        end = self.ends[0]
        gaps = self.turn - self.first + 1 - self.turns if self.turns else 0
        return [gaps, *self.counts.values(), end.cost, end.audit, end.digest.hexdigest()]


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, present): rows damaged by the crc32 of 'conv:turn' modulo 20: 0 goes (present is false), 1 loses its text, 2 its .!?, 3 stands twice, 4 is the user's."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space))
    kind = (F.crc32(key.cast("binary")) % 20).alias("kind")
    plain = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, space).alias("role"), F.coalesce(text, space).alias("text"), kind)
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    there = F.col("kind") != 0
    once = plain.select("conv", "turn", F.when(there, F.when(F.col("kind") == 4, ROLES[0]).otherwise(F.col("role"))).alias("role"), F.when(there, changed).alias("text"), there.alias("present"), "kind")
    twice = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return once.withColumn("copy", twice).select("conv", "turn", "role", "text", "present")


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv, *FIELDS) of every conversation among `rows` (conv, turn, role, text, present). Rows that aren't present only name their conversation."""
    order = F.col("turn").asc_nulls_first()
    same = Window.partitionBy("conv", "role", "text", "present").orderBy(order)
    seen = rows.withColumn("repeat", F.row_number().over(same) > 1)
    dealt = seen.repartition("conv").sortWithinPartitions("conv", order, "role", "text", "repeat")
    schema = StructType([rows.schema["conv"], *[StructField(c, StringType() if c in ("audit", "repaired_sha256") else LongType()) for c in FIELDS]])
    space = " "

    def run(batches):
        names, now, key, any_row = ["conv", "turn", "role", "text", "present", "repeat"], None, None, False
        for batch in batches:
            done = []
            for conv, turn, role, text, present, repeat in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names), strict=True):
                if not any_row or conv != key:
                    if any_row:
                        done.append([key, *now.result()])
                    now, key, any_row = Repair(block), conv, True
                if present:
                    now.add(turn, space if role is None else role, space if text is None else text, repeat)
            if done:
                yield _batch(done, schema)
        if any_row:
            yield _batch([[key, *now.result()]], schema)

    return dealt.select("conv", "turn", "role", "text", "present", "repeat").mapInArrow(run, schema)


def _batch(rows: list[list], schema: StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(column, kinds.field(k).type) for k, column in enumerate(zip(*rows, strict=True))], names=schema.names)
