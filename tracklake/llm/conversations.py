"""Repair of conversation structure: secondary-sorted streaming with a dynamic program of four states."""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.llm.common import read

#: Costs of the edits; an undeleted truncated turn adds ``FLAW``.
REROLE, DELETE, INSERT, FLAW = 3, 4, 3, 3
#: What a repaired conversation spells: ``(s?(ua)+)?``.  States: nothing yet, after s, after u, after a.
_STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
_NEXT = {0: "u", 1: "u", 2: "a", 3: "u"}  # the role that a rerole or an insert must give
_NAMES = {"u": "user", "a": "assistant"}
_ACCEPT = (0, 3)
#: Rows of a conversation that are held in memory before they, and their backpointers, go to a file of the task.
HELD_ROWS, HELD_BYTES = 1 << 16, 32 << 20

#: ids and turns are text in the pandas frames: a column of longs with nulls would turn into doubles there
TURNS = "conv_id string, place long, edit string, role string, text string, turn string, old_role string, fault string"
REPORT = "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def turn_faults(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, fault): each turn's first fault, in one shuffle by conversation.

    ``blank``: no character but ``[\\x20\\x09-\\x0D]``; ``duplicate``: role and text stood
    earlier in the conversation; ``truncated``: the last other character is none of
    ``[.!?]``.  Null roles and texts count as one space.  Turns are ordered by turn
    (nulls first), then role and text, so ties have one order.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    # a window over (conv_id, role, text) is satisfied by the exchange on conv_id, so texts move once
    rows = rows.repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank").when(again, "duplicate").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    return rows.withColumn("fault", fault)


class _Paths:
    """Cheapest edits into each state after the turns so far, and how the paths compare.

    Of each state: cost (None: not reachable).  ``order[p][q]`` compares the edit
    strings of two states: -1 or 1 where they differ, or k > 1: q's string is p's
    and k - 1 inserts more (-k the other way round).  Equal costs never leave such
    a prefix, since an insert costs something, so the order is settled for good.
    """

    def __init__(self) -> None:
        self.cost: list[int | None] = [0, None, None, None]
        self.order = [[0] * 4 for _ in range(4)]
        self.links: list[tuple[int, str] | None] = [(0, ""), None, None, None]  # of the last step: state before it, letters
        self.spread()

    def spread(self) -> None:
        """Inserts after the last turn: they only lead on, so two rounds of the ring close them."""
        base = list(self.cost)
        reach = {s: [(c, s, 0)] for s, c in enumerate(base) if c is not None}  # (cost, from, inserts)
        for s, c in enumerate(base):
            at, n = s, 0
            while c is not None and n < 3:
                at, n = _STEP[at, _NEXT[at]], n + 1
                reach.setdefault(at, []).append((c + n * INSERT, s, n))
        pick: dict[int, tuple[int, int, int]] = {}
        for s, found in reach.items():
            least = min(c for c, _, _ in found)
            best = None
            for c, origin, n in found:
                if c == least and (best is None or self._compare((origin, "I" * n), (best[1], "I" * best[2])) < 0):
                    best = (c, origin, n)
            pick[s] = best
        self._move({s: (c, origin, "I" * n) for s, (c, origin, n) in pick.items()}, inserts=True)

    def _compare(self, a: tuple[int, str], b: tuple[int, str]) -> int:
        """Of two extended paths: -1, 1, 0 (equal), or +-(k + 1) where one is the other and k inserts more."""
        (p, x), (q, y) = a, b
        known = self.order[p][q] if p != q else 0
        if known in (-1, 1):
            return known
        if known > 1:
            y = "I" * (known - 1) + y
        elif known < -1:
            x = "I" * (-known - 1) + x
        if x == y:
            return 0
        if y.startswith(x):
            return len(y) - len(x) + 1
        if x.startswith(y):
            return -(len(x) - len(y) + 1)
        return -1 if x < y else 1

    def _before(self, a: tuple[int, str], b: tuple[int, str]) -> bool:
        """A prefix sorts first."""
        c = self._compare(a, b)
        return c == -1 or c > 1

    def _move(self, to: dict[int, tuple[int, int, str]], inserts: bool = False) -> None:
        order = [[0] * 4 for _ in range(4)]
        for s, (_, p, x) in to.items():
            for r, (_, q, y) in to.items():
                order[s][r] = self._compare((p, x), (q, y)) if s != r else 0
        links = self.links
        self.cost = [to[s][0] if s in to else None for s in range(4)]
        self.order = order
        if inserts:  # joined to the step of the turn itself
            self.links = [(links[to[s][1]][0], links[to[s][1]][1] + to[s][2]) if s in to else None for s in range(4)]
        else:
            self.links = [(to[s][1], to[s][2]) if s in to else None for s in range(4)]

    def turn(self, role: str, fault: str | None) -> None:
        flaw = FLAW if fault == "truncated" else 0
        to: dict[int, tuple[int, int, str]] = {}
        for s, c in enumerate(self.cost):
            if c is None:
                continue
            steps = [(c + DELETE, s, "D")]
            if fault not in ("blank", "duplicate"):
                kept = _STEP.get((s, role[:1])) if role else s
                steps += [(c + flaw, kept, "K")] if kept is not None else []
                steps.append((c + REROLE + flaw, _STEP[s, _NEXT[s]], "R"))
            for cost, state, letter in steps:
                have = to.get(state)
                if have is None or cost < have[0] or (cost == have[0] and self._before((s, letter), (have[1], have[2]))):
                    to[state] = (cost, s, letter)
        self._move(to)
        self.spread()

    def end(self) -> int:
        """The state of the best whole path."""
        best = None
        for s in _ACCEPT:
            if self.cost[s] is not None and (best is None or self.cost[s] < self.cost[best] or (self.cost[s] == self.cost[best] and self._before((s, ""), (best, "")))):
                best = s
        return best

    def record(self) -> bytes:
        """Backpointers of the last step, one byte for each state: state before (2 bits), letter (2), inserts (2)."""
        out = bytearray(4)
        for s, link in enumerate(self.links):
            if link:
                letters = link[1]
                own = letters[:1] if letters[:1] in "DKR" else ""
                out[s] = link[0] | "DKR".index(own) << 2 | (len(letters) - len(own)) << 4 if own else link[0] | 3 << 2 | len(letters) << 4
        return bytes(out)


class _Open:
    """The conversation that is being read: its path costs, and its turns with backpointers, spilled where they are many."""

    def __init__(self, conv_id: object) -> None:
        self.conv_id, self.paths, self.rows, self.back, self.size = conv_id, _Paths(), [], bytearray(), 0
        self.lead = self.paths.record()
        self.file, self.blocks = None, []

    def add(self, turn: object, role: str, text: str, fault: str | None) -> None:
        self.paths.turn(role, fault)
        self.rows.append((turn, role, text, fault))
        self.back += self.paths.record()
        self.size += len(text)
        if len(self.rows) >= HELD_ROWS or self.size >= HELD_BYTES:
            self._spill()

    def _spill(self) -> None:
        """To a file without a name in the task's own temporary space; it ends with the task and no other task reads it."""
        self.file = self.file or tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        self.file.write(self.back)
        pickle.dump(self.rows, self.file, pickle.HIGHEST_PROTOCOL)
        self.blocks.append((at, len(self.back)))
        self.rows, self.back, self.size = [], bytearray(), 0

    def _walk(self, back: bytes, state: int) -> tuple[bytearray, int]:
        """The backpointers on the best path through a block that ends in ``state``; and the state before it."""
        path = bytearray(len(back) // 4)
        for i in range(len(path) - 1, -1, -1):
            path[i] = back[4 * i + state]
            state = path[i] & 3
        return path, state

    def turns(self) -> Iterator[tuple]:
        """(place, edit, role, text, turn, old role, fault) in order."""
        path, state = self._walk(bytes(self.back), self.paths.end())
        for at, length in reversed(self.blocks):  # each block's backpointers give way to its path
            self.file.seek(at)
            own, state = self._walk(self.file.read(length), state)
            self.file.seek(at)
            self.file.write(own)
        lead, place, state = self.lead[state] >> 4, 0, 0
        for _ in range(lead):
            role = _NEXT[state]
            yield place, "I", _NAMES[role], "", None, None, None
            place, state = place + 1, _STEP[state, role]
        for rows, steps in self._stored(path):
            for (turn, role, text, fault), step in zip(rows, steps, strict=True):
                letter = "DKR"[step >> 2 & 3]
                now = role
                if letter == "R":
                    now = _NAMES[_NEXT[state]]
                yield place, letter, now, text, turn, role, fault
                if letter != "D" and now:
                    state = _STEP[state, now[:1]]
                place += 1
                for _ in range(step >> 4):
                    added = _NEXT[state]
                    yield place, "I", _NAMES[added], "", None, None, None
                    place, state = place + 1, _STEP[state, added]
        if self.file:
            self.file.close()

    def _stored(self, path: bytearray) -> Iterator[tuple[list, bytes]]:
        for at, length in self.blocks:
            self.file.seek(at)
            steps = self.file.read(length // 4)
            self.file.seek(at + length)
            yield pickle.load(self.file), steps
        yield self.rows, path


def _null(x: object) -> object:
    return None if x is None or x != x else x


def _texts(frame: DataFrame) -> DataFrame:
    return frame.withColumns({c: F.col(c).cast("string") for c in ("conv_id", "turn")})


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")], dtype=object)


def repair_turns(faulty: DataFrame) -> DataFrame:
    """One row for each edit of each conversation, in order: conv_id, place, edit, role, text, turn, old_role, fault.

    ``faulty`` comes from :func:`turn_faults`.  Edits: K keep (0), R rerole to user
    or assistant (3), D delete (4, required for blank and duplicate turns), I insert
    an empty user or assistant turn (3); undeleted truncated turns add 3.  The
    cheapest edits that spell ``(s?(ua)+)?`` by the first letters of the roles are
    taken, of equal ones the ASCII-least.  Rows of D hold the deleted turn; the
    others in order are the repaired conversation.  A role that is the empty string
    spells nothing where it is kept.

    Each task reads its conversations sorted by turn and carries the state of the
    open one from batch to batch: four costs and how their paths compare.  A turn
    leaves four bytes of backpointers; past ``HELD_ROWS`` turns or ``HELD_BYTES`` of
    text they go with the turns to a file that the task alone uses, as a sort would
    spill, and a lost task simply starts again.  A conversation of any length is
    thus read once in bounded memory.  Null conv_ids form one conversation; no rows
    give no rows; very long texts pass through whole.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        held, now = 0, None

        def close() -> Iterator[pd.DataFrame]:
            nonlocal out, held
            for row in now.turns():
                out.append((now.conv_id, *row))
                held += len(row[3])
                if len(out) >= 10_000 or held >= HELD_BYTES:
                    yield _frame(out, TURNS)
                    out, held = [], 0

        for frame in frames:
            for conv, turn, role, text, fault in zip(frame.conv_id, frame.turn, frame.role, frame.text, frame.fault, strict=True):
                conv = _null(conv)
                if now is None or now.conv_id != conv:
                    if now is not None:
                        yield from close()
                    now = _Open(conv)
                now.add(_null(turn), role, text, _null(fault))
        if now is not None:
            yield from close()
        if out:
            yield _frame(out, TURNS)

    ordered = faulty.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", F.col("fault").asc_nulls_first())
    return _texts(ordered).mapInPandas(run, TURNS).withColumns({c: F.col(c).cast("long") for c in ("conv_id", "turn")})


def _sums() -> dict:
    return {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "first": None, "last": None, "distinct": 0, "before": None, "audit": [], "sha": hashlib.sha256(), "lines": 0}


def repair_report(turns: DataFrame) -> DataFrame:
    """One row for each conversation of :func:`repair_turns`, read straight behind it, so no further shuffle: faults, gaps, cost, audit and the SHA-256 of the repaired ``role:text`` lines."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, s, out = None, None, []

        def row() -> tuple:
            gaps = s["last"] - s["first"] + 1 - s["distinct"] if s["first"] is not None else 0
            return (conv, gaps, *[s[k] for k in ("blank", "duplicate", "truncated", "illegal", "cost")], "".join(s["audit"]), s["sha"].hexdigest())

        for frame in frames:
            for at, edit, role, text, turn, old, fault in zip(frame.conv_id, frame.edit, frame.role, frame.text, frame.turn, frame.old_role, frame.fault, strict=True):
                at, turn, fault = _null(at), _null(turn), _null(fault)
                if s is None or at != conv:
                    if s is not None:
                        out.append(row())
                    conv, s = at, _sums()
                if edit != "I":
                    if fault:
                        s[fault] += 1
                    if s["before"] is not None and s["before"] + old[:1] not in ("su", "ua", "au"):
                        s["illegal"] += 1
                    s["before"] = old[:1]
                    if turn is not None:
                        turn = int(turn)
                        s["distinct"] += turn != s["last"]
                        s["first"], s["last"] = turn if s["first"] is None else s["first"], turn
                if edit != "D":
                    s["sha"].update((("\n" if s["lines"] else "") + f"{role}:{text}").encode())
                    s["lines"] += 1
                s["cost"] += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + (FLAW if fault == "truncated" and edit != "D" else 0)
                s["audit"].append(edit)
            if len(out) >= 1000:
                yield _frame(out, REPORT)
                out = []
        if s is not None:
            out.append(row())
        if out:
            yield _frame(out, REPORT)

    return _texts(turns).mapInPandas(run, REPORT).withColumn("conv_id", F.col("conv_id").cast("long"))


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): conversations with repaired structure, turns numbered from 0.

    See :func:`turn_faults` and :func:`repair_turns`; only conv_id, turn, role and text
    are read, whatever other columns there are.
    """
    kept = repair_turns(turn_faults(conversations)).where("edit <> 'D'")
    return kept.select("conv_id", (F.row_number().over(Window.partitionBy("conv_id").orderBy("place")) - 1).cast("long").alias("turn"), "role", "text")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) damaged by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes its ``[.!?]``, 3 repeats it, 4 makes it the user's.  Nulls are one space."""

    def word(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), word("role").alias("role"), word("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op13_conversations(spark, sf_dir: str) -> DataFrame:
    """The report of :func:`repair_report` over all damaged ``conversations``; one that loses all its rows has zeros, an empty audit and the hash of nothing."""
    rows = read(spark, sf_dir, "conversations")
    report = repair_report(repair_turns(turn_faults(damaged(rows))))
    every = rows.select(F.col("conv_id").cast("long").alias("every")).distinct()
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    out = every.join(report.hint("merge"), F.col("every").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").withColumnRenamed("every", "conv_id")
    return out.withColumns(zero | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256))})
