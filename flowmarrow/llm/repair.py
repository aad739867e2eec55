"""Structure repair of conversations by cheapest edits.

A repaired conversation is empty or has the roles ``(s?(ua)+)?``. Every row is kept, given the role the place needs, or
deleted, and empty turns may be inserted. All of that is a shortest path: nodes are (row, state of the pattern), every
edit is an edge, and the weight of a path is one whole number. Its high digits are the cost; below them stand a fixed
number of digits in base 8, one for each letter of the audit in its place, zero where the audit has ended. Digits follow
the letters' ASCII order, so the smallest number is the cheapest script and, among those, the one with the least audit;
``min`` over whole numbers is the only rule.

A state follows from the letters alone, so two scripts that meet in a node at equal cost differ at some letter that both
have (one that went on from the other would have inserted a whole turn pair, which costs more): the smaller number
stays smaller whatever comes after, and one number per node is enough. Letters on which all nodes agree are settled;
they leave the numbers, and their rows leave memory, so a conversation may be longer than memory.

Rows meet by ``conv_id`` in one sorted stream per task. A conversation is one place of that stream, because its hash
is taken from first to last byte; the task holds the rows between two settled letters, not the conversation.

Null roles and texts read as one blank; an empty role fits no place and is never kept. Rows are taken by turn (nulls first), ties by role and text. A null ``conv_id``
is a conversation of its own. Rows marked ``gone`` only keep their conversation in the result. An empty table has none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmarrow.llm.text import query, table

BLANK = " \t\n\x0b\x0c\r"
BITS = 3
#: Digits of the audit letters, in their ASCII order; 0 is the end of the audit.
DIGITS = {"D": 1, "I": 2, "K": 3, "R": 4}
LETTERS = {d: x for x, d in DIGITS.items()}
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
#: States: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
LEGAL = {"su", "ua", "au"}
#: Rows or characters that may wait before the letters all nodes agree on are settled.
PENDING_ROWS, PENDING_CHARS = 64, 1 << 20
WIDTH = 256


def _filled(state: int) -> int:
    """The state after the turn that the pattern needs next."""
    return ASSISTANT if state == USER else USER


ROLE = {USER: "user", ASSISTANT: "assistant"}


class Script:
    """The cheapest edits of one conversation, fed row by row.

    ``best`` has, for every state that can be reached, the smallest weight and its number of letters.
    """

    def __init__(self, width: int = WIDTH):
        self.width = width
        self.best = {START: (0, 0)}

    def _edge(self, node: tuple[int, int], letter: str, cost: int) -> tuple[int, int]:
        weight, place = node
        return weight + (cost << BITS * self.width) + (DIGITS[letter] << BITS * (self.width - 1 - place)), place + 1

    def _insert(self) -> None:
        """Inserted turns; two in a row at most, since a third would only close a circle."""
        best = self.best
        for to, sources in ((USER, (START, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
            ways = [self._edge(best[s], "I", INSERT) for s in sources if s in best]
            best[to] = min(ways + [best[to]] if to in best else ways)

    def add(self, initial: str, must_go: bool, truncated: bool) -> None:
        self._widen()
        self._insert()
        more = CUT_OFF if truncated else 0
        found: dict[int, list] = {}
        for state, node in self.best.items():
            found.setdefault(state, []).append(self._edge(node, "D", DELETE))
            if not must_go:
                if (state, initial) in KEPT:
                    found.setdefault(KEPT[state, initial], []).append(self._edge(node, "K", KEEP + more))
                found.setdefault(_filled(state), []).append(self._edge(node, "R", REROLE + more))
        self.best = {state: min(ways) for state, ways in found.items()}

    def _widen(self) -> None:
        """Room for the letters of one more row and of the end."""
        if max(place for _, place in self.best.values()) + 5 > self.width:
            low = BITS * self.width
            self.best = {
                s: ((w >> low << 2 * low) | (w & ((1 << low) - 1)) << low, place) for s, (w, place) in self.best.items()
            }
            self.width *= 2

    def _letters(self, weight: int, start: int, stop: int) -> str:
        return "".join(LETTERS[weight >> BITS * (self.width - 1 - k) & 7] for k in range(start, stop))

    def settle(self) -> str:
        """Take out the letters that all nodes begin with."""
        low = (1 << BITS * self.width) - 1
        digits = [w & low for w, _ in self.best.values()]
        differ = 0
        for d in digits[1:]:
            differ |= d ^ digits[0]
        same = min(self.width - -(-differ.bit_length() // BITS), min(place for _, place in self.best.values()))
        out = self._letters(digits[0], 0, same)
        self.best = {s: ((w & ~low) | (w & low) << BITS * same & low, place - same) for s, (w, place) in self.best.items()}
        return out

    def end(self) -> tuple[int, str]:
        """The cost, and the letters that are left."""
        self._insert()
        weight, place = min(self.best[s] for s in (START, ASSISTANT) if s in self.best)
        return weight >> BITS * self.width, self._letters(weight, 0, place)


class Conversation:
    """One conversation on its way through a task; ``take`` gets every edit as (letter, row, new role, new text)."""

    def __init__(self, conv_id, take: Callable[[str, tuple | None, str | None, str | None], None]):
        self.conv_id, self.take = conv_id, take
        self.script, self.pending, self.chars = Script(), [], 0
        self.enough = PENDING_ROWS
        self.state, self.before = START, None
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.turns = 0
        self.first = self.last = None

    def add(self, turn, role: str, text: str, seen: bool) -> None:
        end = text.rstrip(BLANK)[-1:]
        fault = "blank" if not end else "duplicate" if seen else None if end in ".!?" else "truncated"
        if fault:
            self.faults[fault] += 1
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in LEGAL
        self.before = initial
        if turn is not None and turn != self.last:
            self.turns, self.last = self.turns + 1, turn
            self.first = turn if self.first is None else self.first
        self.script.add(initial, fault in ("blank", "duplicate"), fault == "truncated")
        self.pending.append((turn, role, text, fault))
        self.chars += len(text)
        if len(self.pending) >= self.enough or self.chars >= PENDING_CHARS:
            self._apply(self.script.settle())
            # rows that cannot settle yet wait for as many rows again
            self.enough = PENDING_ROWS + len(self.pending)

    def _apply(self, letters: str) -> None:
        at = 0
        for x in letters:
            row = None
            if x != "I":
                row = self.pending[at]
                at += 1
            if x == "D":
                self.take(x, row, None, None)
            elif x == "K":
                self.state = KEPT[self.state, row[1][:1]]
                self.take(x, row, row[1], row[2])
            else:
                self.state = _filled(self.state)
                self.take(x, row, ROLE[self.state], row[2] if row else "")
        del self.pending[:at]
        self.chars = 0

    def end(self) -> int:
        cost, letters = self.script.end()
        self._apply(letters)
        return cost

    @property
    def gaps(self) -> int:
        return 0 if self.first is None else self.last - self.first + 1 - self.turns


def _streamed(rows: DataFrame) -> DataFrame:
    """The rows of every conversation one after another in one task, in order, with ``seen`` for repeated rows."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), gone.alias("gone"))
    met = plain.repartition("conv_id")
    same = Window.partitionBy("conv_id", "role", "text", "gone").orderBy(F.asc_nulls_first("turn"))
    met = met.withColumn("seen", F.row_number().over(same) > 1)
    return met.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch], start: Callable) -> Iterator[Conversation]:
    """Every conversation of a task's stream when its last row is in; ``start(conv_id)`` makes one."""
    now, current = None, object()
    for b in batches:
        for conv_id, turn, role, text, gone, seen in zip(*[b.column(k).to_pylist() for k in range(b.num_columns)]):
            if now is None or conv_id != current:
                if now is not None:
                    yield now
                now, current = start(conv_id), conv_id
            if not gone:
                now.add(turn, role, text, seen)
    if now is not None:
        yield now


EDITS = "step long, edit string, turn long, old_role string, fault string, role string, text string"


def edits(rows: DataFrame) -> DataFrame:
    """The edit script of every conversation of (conv_id, turn, role, text), one row an edit, numbered by ``step``.

    ``role`` and ``text`` are those of the repaired row (null where it is deleted).
    """
    kind = dict(rows.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out = None, []

        def stream():
            nonlocal schema
            for b in batches:
                schema = pa.schema([b.schema.field("conv_id"), *[pa.field(n, t) for n, t in ARROW.items()]])
                yield b

        def start(conv_id):
            step = iter(range(1 << 62))
            return Conversation(conv_id, lambda x, row, role, text: out.append(
                (conv_id, next(step), x, row and row[0], row and row[1], row and row[3], role, text)))

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out.clear()
            return made

        for done in _conversations(stream(), start):
            done.end()
            if len(out) >= 1000:
                yield batch()
        if out:
            yield batch()

    return _streamed(rows).mapInArrow(run, f"conv_id {kind}, {EDITS}")


ARROW = {
    "step": pa.int64(), "edit": pa.string(), "turn": pa.int64(), "old_role": pa.string(), "fault": pa.string(),
    "role": pa.string(), "text": pa.string(),
}


def repaired(rows: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: (conv_id, step, role, text)."""
    return edits(rows).where("edit <> 'D'").select("conv_id", "step", "role", "text")


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def summary(rows: DataFrame) -> DataFrame:
    """One row per conversation: faults, cost and letters of its edits, and the hash of the repaired rows."""
    kind = dict(rows.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, out, digests = None, [], {}

        def stream():
            nonlocal field
            for b in batches:
                field = b.schema.field("conv_id")
                yield b

        def start(conv_id):
            digest, letters = hashlib.sha256(), []

            def take(x, row, role, text):
                letters.append(x)
                if role is not None:
                    digest.update(f"{take.gap}{role}:{text}".encode())
                    take.gap = "\n"

            take.gap = ""
            made = Conversation(conv_id, take)
            made.digest, made.letters = digest, letters
            return made

        def batch():
            schema = pa.schema([field, *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out.clear()
            return made

        for c in _conversations(stream(), start):
            cost = c.end()
            out.append((c.conv_id, c.gaps, *c.faults.values(), c.illegal, cost, "".join(c.letters), c.digest.hexdigest()))
            if len(out) >= 1000:
                yield batch()
        if out:
            yield batch()

    counts = ", ".join(f"{c} long" for c in COUNTS)
    return _streamed(rows).mapInArrow(run, f"conv_id {kind}, {counts}, audit string, repaired_sha256 string")


def damage(rows: DataFrame) -> DataFrame:
    """Faults planted by a checksum of ``conv_id:turn``: rows lost, emptied, cut off, repeated or given to the user."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot: Column = F.crc32(F.concat_ws(":", word("conv_id"), word("turn"))) % 20
    hit = rows.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), lot.alias("lot"))
    text = F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("lot") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return hit.select(
        "conv_id", "turn", F.when(F.col("lot") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("lot") == 0).alias("gone"), F.explode(times).alias("copy"),
    ).drop("copy")


@query()
def op11_conversation_repair(spark, sf_dir):
    return summary(damage(table(spark, sf_dir, "conversations")))
