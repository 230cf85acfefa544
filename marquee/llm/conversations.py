"""Repair of the structure of conversations by Knuth's lightest derivation.

A repaired conversation is empty, or an optional system turn and then pairs of a user and
an assistant turn. The items of the deduction are Prefix(i, state): the first i rows are
repaired and the grammar stands in `state`; and Edit(i, e), an axiom for every edit that
row i allows. From Prefix(i, q) and Edit(i, e) follows Prefix(i + 1, q'), and from
Prefix(i, q) and an insertion Prefix(i, q'). A weight is (cost, audit), the edits'
costs added and their letters joined; weights are compared by cost, then by audit.

Joining never lowers a weight, so it is superior. It also keeps the order of the weights of
one item: there, audits of equal cost are never prefixes of one another, since both hold i
letters for i rows, and one more insertion would cost more. So the agenda's first weight of
an item is its lightest, and the first goal, Prefix(n, accepting), the answer.

Rows come sorted through one shuffle by conversation. The first pass keeps a few bytes a
row (a letter, two flags, a digest); the second streams the texts beside the finished audit.
"""

from __future__ import annotations

import hashlib
from heapq import heappop, heappush
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from marquee.llm.common import settle, table

#: The state after each state's next role initial; states are named by what was seen last, "" at the beginning.
MOVES = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
DUE = {"": "user", "s": "user", "u": "assistant", "a": "user"}
ACCEPTING = ("", "a")
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SPACE = r"\x20\x09-\x0D"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class Audit:
    """A string of edits as a leaf of a tree of common beginnings.

    One letter more is one node; two strings are compared in logarithmic time by pointers
    that jump towards the root. Nodes of one agenda are equal only if they are the same.
    """

    __slots__ = ("letter", "length", "parent", "jump")

    def __init__(self, letter: str = "", parent: Audit | None = None):
        self.letter = letter
        if parent is None:
            self.length, self.parent, self.jump = 0, self, self
        else:
            self.length, self.parent, j = parent.length + 1, parent, parent.jump
            self.jump = j.jump if parent.length - j.length == j.length - j.jump.length else parent

    def cut(self, length: int) -> Audit:
        node = self
        while node.length > length:
            node = node.jump if node.jump.length >= length else node.parent
        return node

    def __lt__(self, other: Audit) -> bool:
        n = min(self.length, other.length)
        a, b = self.cut(n), other.cut(n)
        if a is b:
            return self.length < other.length
        while a.parent is not b.parent:
            a, b = (a.parent, b.parent) if a.jump is b.jump else (a.jump, b.jump)
        return a.letter < b.letter

    def __str__(self) -> str:
        node, letters = self, []
        while node.length:
            letters.append(node.letter)
            node = node.parent
        return "".join(reversed(letters))


def lightest_derivation(axiom, deduce, is_goal):
    """(cost, audit) of the lightest derivation of a goal item.

    deduce(item) gives (cost, letter, consequent) for each deduction from item whose
    other antecedent is an axiom. Items are taken off the agenda by weight and are final
    then; a goal must be derivable.
    """
    agenda, final = [(0, Audit(), axiom)], set()
    while True:
        cost, audit, item = heappop(agenda)
        if item in final:
            continue
        if is_goal(item):
            return cost, str(audit)
        final.add(item)
        for more, letter, consequent in deduce(item):
            if consequent not in final:
                heappush(agenda, (cost + more, Audit(letter, audit), consequent))


def cheapest_repair(rows: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """(cost, audit) for rows of (role initial, must go, truncated)."""
    n = len(rows)

    def deduce(item):
        i, state = item
        due = DUE[state][0]
        yield INSERT, "I", (i, due)
        if i < n:
            initial, must_go, truncated = rows[i]
            yield DELETE, "D", (i + 1, state)
            if not must_go:
                more = TRUNCATED if truncated else 0
                yield REROLE + more, "R", (i + 1, due)
                if (state, initial) in MOVES:
                    yield more, "K", (i + 1, MOVES[state, initial])

    return lightest_derivation((0, ""), deduce, lambda item: item[0] == n and item[1] in ACCEPTING)


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows damaged by a checksum of conv_id and turn.

    Of 20 cases: 0 leaves no copy, 1 empties the text, 2 takes its marks [.!?] away, 3
    leaves two copies, 4 makes the role user. Nulls of role and text are one space, as
    are those of conv_id and turn in the checksum; conv_id and turn keep theirs.
    """
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20
    text = known("text")
    return rows.select(
        "conv_id", "turn", F.when(case == 4, "user").otherwise(known("role")).alias("role"),
        F.when(case == 1, "").when(case == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(case == 0, 0).when(case == 3, 2).otherwise(1).alias("copies"))


def _parts(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, copies_col: str | None) -> DataFrame:
    known = lambda c: F.coalesce(F.col(c), F.lit(" "))
    copies = F.col(copies_col).cast("int") if copies_col else F.lit(1)
    return rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), known(role_col).alias("role"), known(text_col).alias("text"), copies.alias("copies"))


def conversations_of(batches, n: int):
    """Each conversation's rows, as they come sorted: (conversation, iterator of tuples of the n columns behind it).

    The iterator must be used up before the next conversation is asked for.
    """
    rows = (row for b in batches for row in zip(*(b.column(k).to_pylist() for k in range(n + 1))))
    ahead = next(rows, None)

    def of(key):
        nonlocal ahead
        while ahead is not None and ahead[0] == key:
            yield ahead[1:]
            ahead = next(rows, None)

    while ahead is not None:
        key = ahead[0]
        yield key, of(key)


def find_repairs(rows: DataFrame, *, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", copies_col: str | None = None) -> DataFrame:
    """(conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation.

    Rows stand by turn, null first, ties by role and text. copies_col says how often a row
    stands there, if given; a conversation whose rows all stand there 0 times has zeros and
    an empty audit. Nulls of role and text are one space; rows with a null conversation
    are one conversation; turns may repeat. Other columns are left out, so names can't
    clash. No rows give no rows. A task keeps a few bytes a row of one conversation: its
    audit, one letter a row, is a value of the result.
    """
    base = _parts(rows, conv_col, turn_col, role_col, text_col, copies_col)
    kind = rows.schema[conv_col].dataType
    last = F.substring(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\f\r")), -1, 1)
    flagged = base.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select(
        "conv", "turn", "copies", F.substring("role", 1, 1).alias("initial"), last.alias("last"),
        F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text")).alias("digest"))
    schema = flagged.select(F.col("conv").cast(kind).alias(conv_col)).schema
    for c in COUNTS:
        schema = schema.add(c, "long")
    schema = schema.add("audit", "string")

    def one(rows):
        lowest = highest = None
        turns = blank = duplicate = truncated = illegal = 0
        before, seen, codes = None, set(), []
        for turn, copies, initial, last, digest in rows:
            for _ in range(copies or 0):
                if turn is not None and turn != highest:
                    lowest, highest, turns = turn if lowest is None else lowest, turn, turns + 1
                is_blank = not last
                again = not is_blank and digest in seen
                cut = not is_blank and not again and last not in ".!?"
                blank, duplicate, truncated = blank + is_blank, duplicate + again, truncated + cut
                seen.add(digest)
                illegal += before is not None and before + initial not in ("su", "ua", "au")
                before = initial
                codes.append((initial, is_blank or again, cut))
        gaps = 0 if lowest is None else highest - lowest + 1 - turns
        return gaps, blank, duplicate, truncated, illegal, *cheapest_repair(codes)

    arrow = to_arrow_type(kind)

    def run(batches):
        held = []

        def batch():
            columns = [*zip(*held)]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], arrow), *(pa.array(c, pa.int64()) for c in columns[1:7]), pa.array(columns[7], pa.string())], names=schema.names)

        for key, rows in conversations_of(batches, 5):
            held.append((key, *one(rows)))
            if len(held) == 2000:
                yield batch()
                held = []
        if held:
            yield batch()

    return flagged.mapInArrow(run, schema)


def repaired(audit: str, rows):
    """(role, text, edit) of the repaired conversation; rows are (role, text) as they stood."""
    state, rows = "", iter(rows)
    for letter in audit:
        role, text = (None, "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter != "K":
            role = DUE[state]
        state = MOVES[state, role[0]]
        yield role, text, letter


def _beside(rows: DataFrame, repairs: DataFrame, names: dict) -> DataFrame:
    """Repairs and rows in one sorted stream: (conv, audit, role, text, copies, repair); a conversation's repair comes first."""
    conv = names["conv_col"]
    heads = repairs.select(F.col(conv).alias("conv"), F.lit(0).alias("kind"), "audit", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
                           F.lit(None).cast("string").alias("text"), F.lit(0).alias("copies"), F.struct(*COUNTS).alias("repair"))
    parts = _parts(rows, names["conv_col"], names["turn_col"], names["role_col"], names["text_col"], names["copies_col"])
    body = parts.select("conv", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "copies", F.lit(None).cast(heads.schema["repair"].dataType).alias("repair"))
    return heads.unionByName(body).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "text").select("conv", "audit", "role", "text", "copies", "repair")


def _told(rows):
    """(repair, audit, rows of (role, text)) of a conversation of the stream of _beside."""
    audit, _, _, _, repair = next(rows)
    return repair, audit, chain.from_iterable([(role, text)] * (copies or 0) for _, role, text, copies, _ in rows)


def repaired_turns(rows: DataFrame, repairs: DataFrame, *, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", copies_col: str | None = None) -> DataFrame:
    """(conv_col, position, role, text, edit) of the repaired conversations, from rows and their find_repairs.

    position counts from 0. Columns, nulls and ties as in find_repairs. Texts are streamed.
    """
    stream = _beside(rows, repairs, locals())
    schema = stream.select(F.col("conv").alias(conv_col)).schema.add("position", "long").add("role", "string").add("text", "string").add("edit", "string")
    arrow = to_arrow_type(schema[0].dataType)

    def run(batches):
        held, size = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), (arrow, pa.int64(), pa.string(), pa.string(), pa.string()))], names=schema.names)

        for key, own in conversations_of(batches, 5):
            _, audit, told = _told(own)
            for k, (role, text, letter) in enumerate(repaired(audit, told)):
                held.append((key, k, role, text, letter))
                size += len(text)
                if len(held) == 2000 or size > 1 << 22:
                    yield batch()
                    held, size = [], 0
            for _ in told:  # what stands behind the last edit
                pass
            for _ in own:
                pass
        if held:
            yield batch()

    return stream.mapInArrow(run, schema)


def repaired_digests(rows: DataFrame, repairs: DataFrame, *, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", copies_col: str | None = None) -> DataFrame:
    """repairs with repaired_sha256: of the repaired turns as `role:text`, joined by newlines. Texts are streamed."""
    stream = _beside(rows, repairs, locals())
    schema = repairs.select(conv_col, *COUNTS, "audit", F.lit("").alias("repaired_sha256")).schema
    arrow = to_arrow_type(schema[0].dataType)

    def run(batches):
        held = []

        def batch():
            columns = [*zip(*held)]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], arrow), *(pa.array(c, pa.int64()) for c in columns[1:7]), *(pa.array(c, pa.string()) for c in columns[7:])], names=schema.names)

        for key, own in conversations_of(batches, 5):
            repair, audit, told = _told(own)
            digest = hashlib.sha256()
            for k, (role, text, _) in enumerate(repaired(audit, told)):
                digest.update(("\n" * (k > 0) + role + ":" + text).encode())
            for _ in told:
                pass
            for _ in own:
                pass
            held.append((key, *(repair[c] for c in COUNTS), audit, digest.hexdigest()))
            if len(held) == 2000:
                yield batch()
                held = []
        if held:
            yield batch()

    return stream.mapInArrow(run, schema)


def op13_conversation_repair(spark, sf_dir):
    damaged = damage(table(spark, sf_dir, "conversations"))
    repairs = settle(find_repairs(damaged, copies_col="copies"), "repairs")
    return repaired_digests(damaged, repairs, copies_col="copies")
