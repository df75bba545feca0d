"""Repair of conversation structure: the cheapest edits after which roles read ``(s?(ua)+)?``, by iterative deepening A*.

Rows are kept (K, 0), given the role user or assistant (R, 3), deleted (D, 4) or preceded by an inserted empty message
(I, 3); rows that stay truncated add 3; blank and repeated rows must go. The search goes depth first in ASCII order of
the edits under a bound on the cost, raised to the least cost beyond it whenever nothing is found. A table holds for
each state (row, last role) the least cost that it may still need, raised each time a search below the state fails;
so a state is not searched again with no more left than it has failed with. The first path that is accepted under the
final bound is cheapest and, among the cheapest, first in ASCII order.

Only a byte a row reaches the search. Rows pass the workers as a sorted stream, one conversation after the other.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendwise.llm.common import content_key, small_batches, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: White space, and the ends of a whole sentence: fixed values.
BLANK = " \t\n\x0b\x0c\r"
ENDS = ".!?"
OUT_BYTES = 4 << 20
SUFFIX_ROWS = 32

# A row's byte is its initial + 4 * its fault. States are the role written last.
SYSTEM, USER, ASSISTANT, OTHER = 0, 1, 2, 3
SOUND, CUT, GONE = 0, 1, 2
START = 3  # nothing written yet, in the place of an initial
FOLLOWS = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
WRITES = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
FINAL = (START, ASSISTANT)
ROLES = {USER: "user", ASSISTANT: "assistant"}


def set_bounds(codes: bytes, need: array, rows: range) -> None:
    """Cost that state ``4 * row + last`` needs at least, for ``rows`` before a row whose states are known: what each
    row costs in any case, and for disjoint pairs of neighbours that can't both be kept side by side the least that
    changes one of them or fills the gap."""
    known = need[4 * rows.stop : 4 * rows.stop + 4]
    base, extra, beyond = 0, min(known), 0  # extra is from the first row that may stay, beyond from the next one
    ahead = None  # the first row that may stay: its initial, and what changing it adds
    for row in reversed(rows):
        fault, initial = codes[row] >> 2, codes[row] & 3
        if fault == GONE:
            base += DELETE
        else:
            base += TRUNCATED if fault == CUT else 0
            change = DELETE - TRUNCATED if fault == CUT else REROLE
            here = extra + (change if initial == OTHER else 0)
            if ahead is not None:
                legal = initial != OTHER and ahead[0] in FOLLOWS[initial]
                here = max(here, beyond + (0 if legal else min(change, ahead[1])))
            extra, beyond, ahead = here, extra, (initial, change)
        for last in range(4):
            if ahead is None:
                need[4 * row + last] = base + known[last]
            else:
                need[4 * row + last] = base + max(extra, beyond + (0 if ahead[0] in FOLLOWS[last] else ahead[1]))


def steps(codes: bytes, state: int) -> list[tuple[int, int, str]]:
    """``(cost, next state, edit)`` of the edits that a state allows, in ASCII order."""
    row, last = state >> 2, state & 3
    written_role = WRITES[last]
    if row == len(codes):
        return [(INSERT, 4 * row + written_role, "I")]
    fault, initial = codes[row] >> 2, codes[row] & 3
    found = [(DELETE, state + 4, "D"), (INSERT, 4 * row + written_role, "I")]
    if fault != GONE:
        add = TRUNCATED if fault == CUT else 0
        if initial in FOLLOWS[last]:
            found.append((KEEP + add, 4 * row + 4 + initial, "K"))
        found.append((REROLE + add, 4 * row + 4 + written_role, "R"))
    return found


def deepen(codes: bytes, need: array, root: int, goals: set[int]) -> str:
    """The first path from ``root`` to one of ``goals``, whose ``need`` is exact; others are raised on the way, the
    root's to the path's cost."""
    while True:
        path, states, left, open_steps = [], [root], [need[root]], [iter(steps(codes, root))]
        while states:
            state, rest = states[-1], left[-1]
            if state in goals:
                return "".join(path)
            for cost, then, edit in open_steps[-1]:
                if cost + need[then] <= rest:
                    path.append(edit)
                    states.append(then)
                    left.append(rest - cost)
                    open_steps.append(iter(steps(codes, then)))
                    break
            else:
                need[state] = max(need[state], min(cost + need[then] for cost, then, _ in steps(codes, state)))
                states.pop()
                left.pop()
                open_steps.pop()
                if path:
                    path.pop()


def cheapest_edits(codes: bytes) -> tuple[int, str]:
    """Cost and edits of a conversation. In a long one the states of every ``SUFFIX_ROWS``-th row are searched first,
    from the end on and each only as far as the ones before: their exact needs make the bounds of the rows before them
    close, so time grows with the rows."""
    n = len(codes)
    need = array("q", [0]) * (4 * n + 4)
    need[4 * n + SYSTEM], need[4 * n + USER] = 2 * INSERT, INSERT
    goals = accepted = {4 * n + last for last in FINAL}
    for stop in range(n, 0, -SUFFIX_ROWS):
        first = max(0, stop - SUFFIX_ROWS)
        set_bounds(codes, need, range(first, stop))
        if first:
            states = range(4 * first, 4 * first + 4)
            for state in states:
                deepen(codes, need, state, goals)
            goals = set(states)
    edits = deepen(codes, need, START, accepted)
    return need[START], edits


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _messages(conversations: DataFrame) -> DataFrame:
    """Rows with a byte's worth of facts. Null roles and texts count as one space."""
    rows = conversations.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    )
    last = F.substring(F.rtrim("text", F.lit(BLANK)), -1, 1)
    key = content_key("conv_id", "role", "text")
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    return rows.withColumns({
        "initial": place.cast("tinyint"), "blank": last == "", "truncated": ~F.lit(ENDS).contains(last),
        "k1": key[0], "k2": key[1],
    })


ORDER = ["turn", "role", "k1", "k2"]


def audit_conversations(conversations: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` for each conversation; see ``repair``."""
    small_batches(conversations.sparkSession, 4096)
    rows = _messages(conversations).select("conv_id", *ORDER, "initial", "blank", "truncated")
    first = rows.groupBy("k1", "k2").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first"))
    marked = rows.join(first, ["k1", "k2"]).withColumn(
        "again", F.struct(F.col("turn").isNotNull(), "turn") > F.col("first")
    )
    small = marked.select("conv_id", *ORDER, "initial", "blank", "truncated", "again")
    kind = _kind(conversations, "conv_id")
    fields = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    def audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None

        def messages():
            nonlocal schema
            for batch in batches:
                schema = pa.schema([batch.schema.field("conv_id"), *((f, pa.int64()) for f in fields), ("audit", pa.string())])
                yield from zip(*(c.to_pylist() for c in batch.columns))

        done, held = [], 0
        for conversation, group in groupby(messages(), lambda m: m[0]):
            codes, counts, least, most, turns = bytearray(), dict.fromkeys(fields, 0), None, None, 0
            before, before_initial = None, None
            for _, turn, role, k1, k2, initial, blank, cut, again in group:
                if turn is not None and turn != most:
                    least, most, turns = turn if least is None else least, turn, turns + 1
                again = again or before == (turn, k1, k2)
                fault = "blank" if blank else "duplicate" if again else "truncated" if cut else None
                if fault:
                    counts[fault] += 1
                codes.append(initial + 4 * (GONE if blank or again else CUT if cut else SOUND))
                if before is not None:
                    between = (before_initial, initial)
                    counts["illegal"] += between not in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))
                before, before_initial = (turn, k1, k2), initial
            counts["gaps"] = 0 if least is None else most - least + 1 - turns
            counts["cost"], audit = cheapest_edits(bytes(codes))
            done.append({"conv_id": conversation, **counts, "audit": audit})
            held += 100 + len(audit)
            if held > OUT_BYTES:
                yield pa.RecordBatch.from_pylist(done, schema)
                done, held = [], 0
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    return small.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), *ORDER).mapInArrow(
        audited, f"conv_id {kind}, " + ", ".join(f"{f} bigint" for f in fields) + ", audit string"
    )


def apply_edits(conversations: DataFrame, audits: DataFrame) -> DataFrame:
    """Messages ``conv_id, place, edit, role, text`` after the edits of ``audits(conv_id, audit)``, each conversation's
    in one run and in order of ``place`` (from 0), ``edit`` one of I, K and R. Conversations without an audit are left out."""
    small_batches(conversations.sparkSession)
    kind = _kind(conversations, "conv_id")
    rows = _messages(conversations).select("conv_id", F.lit(1).alias("part"), *ORDER, "initial", "text")
    plans = audits.select(
        "conv_id", F.lit(0).alias("part"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"),
        F.lit(None).cast("bigint").alias("k1"), F.lit(None).cast("bigint").alias("k2"),
        F.lit(0).cast("tinyint").alias("initial"), F.col("audit").alias("text"),
    )

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]
        out, held = [], 0
        conversation, edits, at, last, place = None, None, 0, START, 0

        def write(edit: str, role: str, text: str, initial: int) -> None:
            nonlocal last, place, held
            out.append({"conv_id": conversation, "place": place, "edit": edit, "role": role, "text": text})
            last, place, held = initial, place + 1, held + 100 + len(text)

        def inserts() -> None:
            nonlocal at
            while edits is not None and at < len(edits) and edits[at] == "I":
                at += 1
                write("I", ROLES[WRITES[last]], "", WRITES[last])

        for batch in batches:
            schema = pa.schema([batch.schema.field("conv_id"), *names])
            for conv_id, part, role, initial, text in zip(
                *(batch.column(c).to_pylist() for c in ("conv_id", "part", "role", "initial", "text"))
            ):
                if part == 0 or conv_id != conversation:
                    inserts()  # behind the last row of the conversation before
                    conversation, edits, at, last, place = conv_id, text if part == 0 else None, 0, START, 0
                if part == 0 or edits is None:
                    continue
                inserts()
                edit, at = edits[at], at + 1
                if edit == "K":
                    write("K", role, text, initial)
                elif edit == "R":
                    write("R", ROLES[WRITES[last]], text, WRITES[last])
                if held > OUT_BYTES:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out.clear()
                    held = 0
        inserts()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    stream = plans.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "part", *ORDER)
    return stream.mapInArrow(edited, f"conv_id {kind}, place bigint, edit string, role string, text string")


def conversation_digests(messages: DataFrame) -> DataFrame:
    """``conv_id, sha256`` of ``role:text`` joined by line feeds, for messages as ``apply_edits`` returns them: each
    conversation's in one run and in order, so that none is held whole."""
    kind = _kind(messages, "conv_id")

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_id, digest = None, None
        for batch in batches:
            schema = pa.schema([batch.schema.field("conv_id"), ("sha256", pa.string())])
            done = []
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                line = f"{role}:{text}".encode()
                if digest is not None and conv_id == open_id:
                    digest.update(b"\n" + line)
                    continue
                if digest is not None:
                    done.append({"conv_id": open_id, "sha256": digest.hexdigest()})
                open_id, digest = conv_id, hashlib.sha256(line)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if digest is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": open_id, "sha256": digest.hexdigest()}], schema)

    return messages.select("conv_id", "role", "text").mapInArrow(digested, f"conv_id {kind}, sha256 string")


def repair_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Audits and repaired messages of ``conversations(conv_id, turn, role, text)``.

    Rows stand in order of turn, null turns first; rows of one turn by role, then by a hash of their content, so that
    equal rows are neighbours. A row's first fault counts: blank, duplicate (role and text seen earlier), truncated
    (the last character that is not white space ends no sentence). Null roles and texts count as one space, a null
    conv_id is a conversation of its own. An audit has the counts of faults, of missing turns between the first and
    the last (``gaps``) and of illegal neighbours, the least cost and its edits. Messages are ``conv_id, place, edit,
    role, text``. Other columns are not read; an empty table gives empty results.

    A conversation is one task's work in the two sorted passes, since its edits and digest follow one another; a task
    holds one batch of its rows and about 60 bytes for each, not its texts. Repeats are found beforehand, by an
    aggregate on content that no conversation holds up.
    """
    audits = written(audit_conversations(conversations), "conversation-audits")
    return audits, apply_edits(conversations, audits)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with the faults that crc32 of ``conv_id:turn`` modulo 20 deals out: 0 drops the row, 1 empties its text,
    2 removes its ``.``, ``!`` and ``?``, 3 repeats it, 4 makes it the user's. Nulls count as one space throughout."""

    def text_of(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    code = F.crc32(F.encode(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")), "UTF-8")) % 20
    text, role = text_of("text"), text_of("role")
    return (
        conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), code.alias("code"))
        .where("code <> 0")
        .select(
            "conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text")).alias("text"),
            F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        )
        .drop("copy")
    )
