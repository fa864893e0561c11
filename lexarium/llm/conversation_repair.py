"""Repair of conversation structure by signature deduplication.

A conversation's rows become one letter each, for the role's initial and the first fault, and its letters, in order, a
compact string: its signature. All that the structure decides (fault counts, illegal pairs, the cheapest edits) follows
from the signature, so each distinct one is solved once, by a memoised recursion over its suffixes. The audit joins
back on the signature and is replayed over the conversation's rows, which stream past sorted; nothing holds the texts
of a conversation together.

Letters: s u a o for a sound row (o: any other initial), S U A O for a truncated one, 1 2 3 4 for a blank one, 5 6 7 8
for a duplicate. A null conv_id is a conversation of its own; nulls of any column read as one space in text, role and
the damage's key. Rows of one turn are ordered by a digest of role and text; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_WS, materialize, read_table
from .turns import digest, placed

KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 1, 2, 5, 5
PIECE = 4096
FAULTS = {"blank": "1234", "duplicate": "5678", "truncated": "SUAO"}
LEGAL = ("su", "ua", "au")
NEVER = float("inf")
#: States: nothing yet, after the system turn, after a user's, after an assistant's. What comes next if a role is chosen.
FOLLOWS = (2, 2, 3, 2)
#: State after keeping a row with that initial.
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "o": {}}
ROLES = {2: "user", 3: "assistant"}


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, copy, role, text after the damage that crc32 of `conv_id:turn` decides."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), plain("role").alias("role"), plain("text").alias("text"), code.alias("code")).where("code != 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", copies.alias("copy"), role.alias("role"), text.alias("text"))


def coded(rows: DataFrame) -> DataFrame:
    """conv_id, turn, pos, letter of damaged rows; the texts stay behind, as digests."""
    initial = F.substring("role", 1, 1)
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\f\r")), F.lit(1))
    thin = rows.select(
        "conv_id", "turn", "copy", *digest(F.col("role"), F.col("text")), F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"),
        (~F.col("text").rlike(NOT_WS)).alias("blank"), (~last.isin(".", "!", "?")).alias("open"),
    )
    thin = materialize(placed(thin, "conv_id", ["turn", "d1", "d2", "copy"]), "coded")
    seen = thin.groupBy("conv_id", "d1", "d2").agg(F.min("pos").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    seen = seen.select(F.col("conv_id").alias("_c"), F.col("d1").alias("_1"), F.col("d2").alias("_2"), "_first")
    thin = thin.join(seen, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("d1") == F.col("_1")) & (F.col("d2") == F.col("_2")), "left")
    as_fault = lambda kind: F.translate("initial", "suao", FAULTS[kind])
    letter = F.when(F.col("blank"), as_fault("blank")).when(F.col("pos") > F.col("_first"), as_fault("duplicate")).when(F.col("open"), as_fault("truncated")).otherwise(F.col("initial"))
    return thin.select("conv_id", "turn", "pos", letter.alias("letter"))


def signatures(conversations: DataFrame, letters: DataFrame) -> DataFrame:
    """conv_id, gaps, signature of every original conversation; pieces of 4096 letters are joined first."""
    joined = lambda c, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, c))), lambda x: x[c]), "")
    pieces = letters.groupBy("conv_id", F.floor(F.col("pos") / PIECE).alias("piece")).agg(joined("letter", "pos").alias("part"))
    whole = pieces.groupBy("conv_id").agg(joined("part", "piece").alias("signature"))
    turns = letters.where("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    none = lambda kind: F.lit(None).cast(kind)
    every = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct().select("conv_id", none("string").alias("signature"), none("bigint").alias("gaps"))
    rows = every.unionByName(whole.withColumn("gaps", none("bigint"))).unionByName(turns.withColumn("signature", none("string")))
    return rows.groupBy("conv_id").agg(F.coalesce(F.max("gaps"), F.lit(0).cast("bigint")).alias("gaps"), F.coalesce(F.max("signature"), F.lit("")).alias("signature"))


def read_letter(letter: str) -> tuple[str, str]:
    """(initial, fault or '')."""
    for fault, letters in FAULTS.items():
        if letter in letters:
            return "suao"[letters.index(letter)], fault
    return letter, ""


Costs = tuple[float, float, float, float]


def with_inserts(cost: Costs) -> Costs:
    """The costs if turns may be inserted first: a role leads to the next, so at most two pay."""
    user, assistant = min(cost[2], INSERT + cost[3]), min(cost[3], INSERT + cost[2])
    return min(cost[0], INSERT + user), min(cost[1], INSERT + user), user, assistant


END: Costs = with_inserts((0, NEVER, NEVER, 0))


def options(letter: str, state: int, after: Costs) -> dict[str, tuple[float, int]]:
    """Edit: (cost to the end, state after it) of the edits that use the row up."""
    initial, fault = read_letter(letter)
    out = {"D": (DELETE + after[state], state)}
    if fault in ("", "truncated"):
        extra = UNFINISHED if fault else 0
        if (kept := KEPT[initial].get(state)) is not None:
            out["K"] = (KEEP + extra + after[kept], kept)
        out["R"] = (REROLE + extra + after[FOLLOWS[state]], FOLLOWS[state])
    return out


@lru_cache(maxsize=100_000)
def ahead(letter: str, after: Costs) -> tuple[Costs, float]:
    """Costs to the end from each state before a row, given those behind it, less their least; and that least. Suffixes with equal relative costs are one case, so few are ever worked out."""
    cost = with_inserts(tuple(min(c for c, _ in options(letter, s, after).values()) for s in range(4)))
    least = min(cost)
    return tuple(c - least for c in cost), least


@lru_cache(maxsize=100_000)
def first_edit(letter: str, state: int, here: Costs, after: Costs, least: float) -> tuple[str, int, bool]:
    """(the ASCII-least edit of a cheapest way, state after it, whether it used the row up)."""
    ways = options(letter, state, after)
    for edit in "DIKR":
        if edit == "I" and INSERT + here[FOLLOWS[state]] == here[state]:
            return edit, FOLLOWS[state], False
        if edit in ways and ways[edit][0] - least == here[state]:
            return edit, ways[edit][1], True
    raise AssertionError("no cheapest edit")


def solve(signature: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits. The recursion is worked off from the last row, so that its depth isn't the conversation's length."""
    table: list[tuple[Costs, float]] = [(END, 0.0)]
    for letter in reversed(signature):
        table.append(ahead(letter, table[-1][0]))
    table.reverse()
    cost, state, audit, k = sum(least for _, least in table) + table[0][0][0], 0, [], 0
    while k < len(signature):
        edit, state, used = first_edit(signature[k], state, table[k][0], table[k + 1][0], table[k][1])
        audit.append(edit)
        k += used
    while state not in (0, 3):
        audit.append("I")
        state = FOLLOWS[state]
    return int(cost), "".join(audit)


SOLVED = "signature string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def solved(distinct: DataFrame) -> DataFrame:
    """SOLVED of each signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(0).to_pylist()
            columns: list[list] = [given, *([sum(map(s.count, letters)) for s in given] for letters in FAULTS.values())]
            initials = [s.translate(str.maketrans("".join(FAULTS.values()), "suao" * len(FAULTS))) for s in given]
            columns.append([sum(s[k : k + 2] not in LEGAL for k in range(len(s) - 1)) for s in initials])
            answers = [solve(s) for s in given]
            columns += [[a[0] for a in answers], [a[1] for a in answers]]
            kinds = [pa.string(), *[pa.int64()] * 5, pa.string()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SOLVED.split(", ")])

    return distinct.select("signature").distinct().mapInArrow(run, SOLVED)


class Replay:
    """Feeds a conversation's repaired turns to a hash, one by one."""

    def __init__(self, audit: str):
        self.edits, self.at, self.state, self.any, self.hash = audit, 0, 0, False, hashlib.sha256()

    def emit(self, role: str, text: str) -> None:
        self.hash.update(f"{'\n' if self.any else ''}{role}:{text}".encode(errors="surrogatepass"))
        self.any = True

    def inserts(self) -> None:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self.state = FOLLOWS[self.state]
            self.emit(ROLES[self.state], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.edits[self.at]
        self.at += 1
        if edit == "K":
            self.state = KEPT[role[:1]][self.state]
            self.emit(role, text)
        elif edit == "R":
            self.state = FOLLOWS[self.state]
            self.emit(ROLES[self.state], text)

    def digest(self) -> str:
        self.inserts()
        return self.hash.hexdigest()


RESULT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_NUMBERS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def replayed(audits: DataFrame, rows: DataFrame) -> DataFrame:
    """RESULT: each conversation's numbers and audit come first in its partition, then its damaged rows in order."""
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    heads = audits.select("conv_id", F.lit(0).alias("kind"), none("turn", "bigint"), none("d1", "bigint"), none("d2", "bigint"), none("copy", "int"), none("role", "string"), F.col("audit").alias("text"), F.array(*_NUMBERS).alias("numbers"))
    body = rows.select("conv_id", F.lit(1).alias("kind"), "turn", *digest(F.col("role"), F.col("text")), "copy", "role", "text", none("numbers", "array<bigint>"))
    stream = heads.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "d1", "d2", "copy")
    names = [x.split()[0] for x in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_one: tuple[int | None, list[int], Replay] | None = None

        def closed() -> list[tuple]:
            return [] if open_one is None else [(open_one[0], *open_one[1], open_one[2].edits, open_one[2].digest())]

        def packed(out: list[tuple]) -> pa.RecordBatch:
            kinds = [*[pa.int64()] * 7, pa.string(), pa.string()]
            return pa.record_batch([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=names)

        for batch in batches:
            out: list[tuple] = []
            for conv_id, kind, role, text, numbers in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if kind == 0:
                    out += closed()
                    open_one = (conv_id, numbers, Replay(text))
                else:
                    open_one[2].row(role, text)
            yield packed(out)
        if open_one is not None:
            yield packed(closed())

    return stream.select("conv_id", "kind", "role", "text", "numbers").mapInArrow(run, RESULT)


def repair(conversations: DataFrame) -> DataFrame:
    """RESULT of every conversation (conv_id, turn, role, text)."""
    rows = damaged(conversations)
    known = materialize(signatures(conversations, materialize(coded(rows), "letters")), "signatures")
    audits = known.join(solved(known), "signature").select("conv_id", *_NUMBERS, "audit")
    return replayed(audits, rows)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(read_table(spark, sf_dir, "conversations"))
