"""Repair of the turn structure of conversations.

A well-formed conversation has role initials ``(s?(ua)+)?``.  Turns are edited at least
cost: kept (0), given the role user or assistant (1), deleted (2; blank and repeated
turns must be), or an empty turn of either role is inserted (5); a truncated turn that
stays costs 5 more.

The grammar has one string for each length: ``uaua...``, after an ``s`` if the length
is odd.  So turns are aligned to each feasible length by Wagner and Fischer's table, a
diagonal band of it only (Ukkonen): a cell is left out if its way to both corners must
cost more than the best alignment so far.  Alignments of equal cost are compared by
their audits, the edits' initials in order.

Long conversations are aligned in blocks of ``BLOCK_TURNS``.  A block is aligned from
every place of the grammar at which it may begin to every place at which it may end.  Two
alignments of one block with the same cost and the same ends never have audits of which
one begins with the other (it would have inserted more), so the least audit of the
whole is made of least audits of the blocks.  With every alignment that goes on, the
digest of the repaired turns so far is carried along: a conversation streams once through
its task and only a block of it is held, besides the audits.

Turns are dealt by conversation, since the digest of a conversation is one pass over its
turns in order.  Repeats are found by a window whose rows share role and text, and both
sorts can spill.

Order and nulls: turns are taken by number (nulls first), then by role and text.  A
null role or text is one space, and so are a null number and a null conversation id where the damage is
drawn; rows without a conversation id are one conversation.  An empty
role has no initial and fits nowhere.  Repeated rows are repeats; an empty table gives no rows;
conversations that lose all turns are returned with zeros; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RELABEL, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Turns of a conversation that are aligned at once.
BLOCK_TURNS = 32
#: Alignments of blocks that a worker keeps.
CACHE_BLOCKS = 100_000
#: Fixed value: characters that are white space here.
SPACE = "\\x20\\x09-\\x0D"
#: Places of the grammar: nothing yet, after s, after u, after a.
PLACES = "0sua"
ENDS = "0a"
ROLES = {"u": "user", "a": "assistant"}
_INF = 1 << 40
_NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damage(rows: DataFrame) -> DataFrame:
    """A twentieth of the turns each is dropped, emptied, unpunctuated, repeated, and given to the user.

    Dropped turns are still there, marked as ``gone``, so that ``repair`` lists their conversations.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(name("conv_id"), F.lit(":"), name("turn")), "UTF-8")) % 20
    drawn = rows.select("conv_id", "turn", name("role").alias("speaker"), name("text").alias("body"), kind.alias("kind"))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("body", ".!?", "")).otherwise(F.col("body"))
    times = F.array_repeat("kind", F.when(F.col("kind") == 3, 2).otherwise(1).cast("int"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("speaker"))
    return drawn.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("kind")).select("conv_id", "turn", "role", "text", (F.col("kind") == 0).alias("gone"))


def code(role: Column, text: Column, seen: Column) -> Column:
    """One letter for a turn: ``b``lank, ``d``uplicate, or its initial (``o`` for others), in upper case if truncated."""
    initial = F.when(F.substring(role, 1, 1).isin("s", "u", "a"), F.substring(role, 1, 1)).otherwise("o")
    cut = ~text.rlike(f"[.!?][{SPACE}]*\\z")
    return F.when(~text.rlike(f"[^{SPACE}]"), "b").when(seen, "d").when(cut, F.upper(initial)).otherwise(initial)


def place_after(start: str, length: int) -> str:
    """Where ``length`` turns without a leading s lead."""
    if not length:
        return start
    return "ua"[(length + (start == "u") + 1) % 2]


def target(start: str, length: int) -> str:
    """The grammar's turns from a place on, without a leading s."""
    return (("au" if start == "u" else "ua") * ((length + 1) // 2))[:length]


class Aligner:
    """Least alignments of blocks of turns."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, str], dict[str, tuple[int, str]]] = {}

    def block(self, codes: str, start: str) -> dict[str, tuple[int, str]]:
        """Cost and audit of the least alignment from ``start`` to every place that can be reached."""
        found = self.known.get((codes, start))
        if found is None:
            if len(self.known) > CACHE_BLOCKS:
                self.known.clear()
            found = self.known[codes, start] = self._block(codes, start)
        return found

    def _block(self, codes: str, start: str) -> dict[str, tuple[int, str]]:
        best: dict[str, tuple[int, str]] = {}
        free = sum(c not in "bd" for c in codes)
        least = DELETE * (len(codes) - free)
        # Lengths near the number of turns that may stay come first: they make bands narrow.
        for gap in range(free + len(codes) + 4):
            lengths = {free - gap, free + gap}
            for length in sorted(x for x in lengths if x >= 0):
                floor = least + (INSERT * (length - free) if length > free else DELETE * (free - length))
                for lead in ("", "s") if start == "0" and length else ("",):
                    goal = lead + target(start, length - len(lead))
                    end = "s" if goal == "s" else place_after(start, length - len(lead))
                    limit = best.get(end, (_INF, ""))[0]
                    if floor > limit:
                        continue
                    made = self.align(codes, goal, limit)
                    if made is not None:
                        best[end] = min(best.get(end, made), made)
            worst = max((best.get(p, (_INF, ""))[0] for p in self._reachable(start)), default=_INF)
            if gap and least + DELETE * gap > worst:
                break
        return best

    @staticmethod
    def _reachable(start: str) -> str:
        return {"0": "0ua", "s": "sua"}.get(start, "ua")

    @staticmethod
    def align(codes: str, goal: str, limit: int) -> tuple[int, str] | None:
        """Cost and least audit of aligning turns to ``goal``, unless that costs more than ``limit``.

        ``need[i][j]`` is the least cost of aligning the turns from i on to the goal from j
        on; rows hold the cells of a band only.
        """
        m, n = len(codes), len(goal)
        forced = [0] * (m + 1)
        for i in range(m - 1, -1, -1):
            forced[i] = forced[i + 1] + (codes[i] in "bd")
        rest = lambda free, left: INSERT * (left - free) if left > free else DELETE * (free - left)
        need: list[dict[int, int]] = [{} for _ in range(m + 2)]
        total = DELETE * forced[0]
        for i in range(m, -1, -1):
            free = m - i - forced[i]
            before = i - (forced[0] - forced[i])
            row, below = need[i], need[i + 1]
            c = codes[i] if i < m else ""
            low = c.lower()
            extra = TRUNCATED if c.isupper() else 0
            for j in range(n, -1, -1):
                if total + rest(before, j) + rest(free, n - j) > limit:
                    continue
                if i == m and j == n:
                    row[j] = 0
                    continue
                cost = _INF
                if i < m:
                    cost = below.get(j, _INF) + DELETE
                    if j < n and c not in "bd":
                        if low == goal[j]:
                            cost = min(cost, below.get(j + 1, _INF) + extra)
                        elif goal[j] != "s":
                            cost = min(cost, below.get(j + 1, _INF) + RELABEL + extra)
                if j < n and goal[j] != "s":
                    cost = min(cost, row.get(j + 1, _INF) + INSERT)
                if cost < _INF:
                    row[j] = cost
        whole = need[0].get(0)
        if whole is None or whole > limit:
            return None
        # Edits in the order of their initials, as soon as one is on a least way.
        out, i, j = [], 0, 0
        while i < m or j < n:
            left = need[i][j]
            if i < m and need[i + 1].get(j, _INF) + DELETE == left:
                out.append("D")
                i += 1
            elif j < n and goal[j] != "s" and need[i].get(j + 1, _INF) + INSERT == left:
                out.append("I")
                j += 1
            else:
                out.append("K" if codes[i].lower() == goal[j] else "R")
                i, j = i + 1, j + 1
        return whole, "".join(out)


class Repair:
    """A conversation so far: for each place of the grammar the least cost, audit and digest."""

    def __init__(self, aligner: Aligner):
        self.aligner = aligner
        self.ways = {"0": (0, "", hashlib.sha256(), False)}
        self.settled: list[str] = []
        self.held: list[tuple[str, str, str]] = []
        self.count = dict.fromkeys(_NUMBERS, 0)
        self.first: int | None = None
        self.last: int | None = None
        self.numbers = 0
        self.initial: str | None = None

    def add(self, turn: int | None, role: str, text: str, letter: str) -> None:
        if turn is not None:
            self.numbers += turn != self.last
            self.first, self.last = (turn if self.first is None else self.first), turn
        own = role[:1]
        self.count["illegal"] += self.initial is not None and (self.initial, own) not in (("s", "u"), ("u", "a"), ("a", "u"))
        self.initial = own
        self.count["blank"] += letter == "b"
        self.count["duplicate"] += letter == "d"
        self.count["truncated"] += letter.isupper()
        self.held.append((role, text, letter))
        if len(self.held) == BLOCK_TURNS:
            self._advance()

    def _advance(self) -> None:
        codes = "".join(letter for _, _, letter in self.held)
        ways: dict[str, tuple[int, str, str]] = {}
        for start, (cost, audit, *_) in self.ways.items():
            for end, (more, edits) in self.aligner.block(codes, start).items():
                way = (cost + more, audit + edits, start)
                if end not in ways or way < ways[end]:
                    ways[end] = way
        made = {}
        for end, (cost, audit, start) in ways.items():
            _, before, digest, begun = self.ways[start]
            digest = digest.copy()
            at, place = 0, start
            for edit in audit[len(before) :]:
                role, text, letter = self.held[at] if edit != "I" else ("", "", "")
                at += edit != "I"
                if edit == "D":
                    continue
                place = letter.lower() if edit == "K" else "a" if place == "u" else "u"
                digest.update(f"{chr(10) if begun else ''}{role if edit == 'K' else ROLES[place]}:{text}".encode())
                begun = True
            made[end] = (cost, audit, digest, begun)
        # What all ways begin with is put aside, so that audits stay short.
        common = len(os.path.commonprefix([way[1] for way in made.values()]))
        self.settled.append(next(iter(made.values()))[1][:common])
        self.ways = {end: (cost, audit[common:], digest, begun) for end, (cost, audit, digest, begun) in made.items()}
        self.held = []

    def result(self) -> dict:
        if self.held:
            self._advance()
        cost, audit, digest, _ = min((self.ways[p] for p in ENDS if p in self.ways), key=lambda way: way[:2])
        gaps = self.last - self.first + 1 - self.numbers if self.numbers else 0
        return {**self.count, "gaps": gaps, "cost": cost, "audit": "".join(self.settled) + audit, "repaired_sha256": digest.hexdigest()}


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repairs conversations that arrive in order; one may go on in the next Arrow batch."""
    aligner = Aligner()
    now: Repair | None = None
    current: object = None
    for batch in batches:
        done: list[dict] = []
        for conv, turn, role, text, letter in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "code")), strict=True):
            if now is None or conv != current:
                if now is not None:
                    done.append({"conv_id": current, **now.result()})
                now, current = Repair(aligner), conv
            if letter:
                now.add(turn, role, text, letter)
        yield _batch(done, batch.schema.field("conv_id").type)
    if now is not None:
        yield _batch([{"conv_id": current, **now.result()}], batch.schema.field("conv_id").type)


def _batch(rows: list[dict], key: pa.DataType) -> pa.RecordBatch:
    kinds = {"conv_id": key, **dict.fromkeys(_NUMBERS, pa.int64()), "audit": pa.string(), "repaired_sha256": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in kinds.items()], names=list(kinds))


def repair(rows: DataFrame) -> DataFrame:
    """Faults, cost, audit and digest of the repaired turns, a row for each conversation of ``conv_id, turn, role, text``.

    Turns with a true ``gone``, if there is such a column, count for nothing but their conversation's row.
    """
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    gone = F.coalesce("gone", F.lit(False)) if "gone" in rows.columns else F.lit(False)
    turns = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"), gone.alias("gone")).repartition("conv_id")
    seen = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    letter = F.when(F.col("gone"), "").otherwise(code(F.col("role"), F.col("text"), F.col("seen")))
    ordered = turns.withColumn("seen", seen).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "seen")
    numbers = ", ".join(f"{c} long" for c in _NUMBERS)
    kept = ordered.select("conv_id", "turn", "role", "text", letter.alias("code"))
    return kept.mapInArrow(_run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {numbers}, audit string, repaired_sha256 string")
