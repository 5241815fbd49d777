"""Repair of conversations: the cheapest edits that make their turns alternate.

A conversation is right if it holds nothing, or perhaps one system turn and then
user and assistant by turns, ending with the assistant. Its rows are read as
symbols, of a role's initial and a fault, and equal symbols in a row are one run.
What the rest of a conversation costs, from each of the four states that a prefix
can leave, is a vector; a run of equal rows takes it back by a power of the
symbol's min-plus transition, from powers of two that are made once. The choices
are then unrolled in order, the least letter that keeps the cost each time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import materialize, tidy

#: Costs of deleting, inserting and changing a role, and of leaving a truncated text.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
NEVER = 1 << 60

#: States: nothing yet, after the system turn, after a user's, after an assistant's. Ends are allowed in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: The role that a state lets be inserted or given to a row.
WANTED = {START: "u", SYSTEM: "u", ASSISTANT: "u", USER: "a"}

Matrix = tuple[tuple[int, ...], ...]
Vector = tuple[int, ...]


def product(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product: the cheapest way by ``a`` and then by ``b``."""
    return tuple(tuple(min(min(x + y for x, y in zip(row, column)), NEVER) for column in zip(*b)) for row in a)


def before(a: Matrix, costs: Vector) -> Vector:
    """What the rest costs before a step, from what it costs after it."""
    return tuple(min(min(x + y for x, y in zip(row, costs)), NEVER) for row in a)


def _of(cheapest: dict[tuple[int, int], int]) -> Matrix:
    return tuple(tuple(cheapest.get((p, q), NEVER) for q in range(4)) for p in range(4))


@lru_cache
def insertions() -> Matrix:
    """The cheapest insertions between two states; three of them reach all that any number does."""
    one = _of({(p, p): 0 for p in range(4)} | {(p, STEPS[p, role]): INSERT for p, role in WANTED.items()})
    return product(product(one, one), one)


def choices(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of what may be done with a row. ``symbol``: its initial, then t for truncated or x for what has to go."""
    out = [("D", DELETE, state)]
    if symbol[-1] != "x":
        more = TRUNCATED if symbol[-1] == "t" else 0
        if (state, symbol[0]) in STEPS:
            out.append(("K", more, STEPS[state, symbol[0]]))
        out.append(("R", REROLE + more, STEPS[state, WANTED[state]]))
    return out


@lru_cache(maxsize=None)
def power(symbol: str, k: int) -> Matrix:
    """The transition of 2^k rows of a symbol, insertions before each of them included."""
    if k:
        return product(power(symbol, k - 1), power(symbol, k - 1))
    ways: dict[tuple[int, int], int] = {}
    for p in range(4):
        for _, cost, q in choices(symbol, p):
            ways[p, q] = min(cost, ways.get((p, q), NEVER))
    return product(insertions(), _of(ways))


def before_run(symbol: str, length: int, costs: Vector) -> Vector:
    """What the rest costs before ``length`` rows of a symbol, from what it costs after them."""
    for k in range(length.bit_length()):
        if length >> k & 1:
            costs = before(power(symbol, k), costs)
    return costs


class Unroll:
    """The choices of one conversation in order, equal ones in a row as one (n, inserted roles, edit, given role)."""

    def __init__(self) -> None:
        self.state, self.out = START, []

    def insert(self) -> str:
        role = WANTED[self.state]
        self.state = STEPS[self.state, role]
        return role

    def row(self, n: int, symbol: str, here: Vector, after: Vector) -> None:
        """One row: ``here`` and ``after`` are what all costs from before and after it. Of the cheapest edits the least letter is taken."""
        roles = ""
        while True:
            cheapest = [(edit, q) for edit, cost, q in choices(symbol, self.state) if cost + after[q] == here[self.state]]
            if INSERT + here[STEPS[self.state, WANTED[self.state]]] == here[self.state]:
                cheapest.append(("I", -1))
            edit, state = min(cheapest)
            if edit != "I":
                break
            roles += self.insert()
        made = (roles, edit, WANTED[self.state] if edit == "R" else "")
        self.state = state
        if not self.out or self.out[-1][1:] != made:
            self.out.append((n, *made))

    def run(self, n: int, symbol: str, length: int, after: Vector) -> None:
        """Rows n and on of one symbol, halved until they are single: so no more than a vector for each halving is kept."""
        if length == 1:
            self.row(n, symbol, before_run(symbol, 1, after), after)
            return
        half = 1 << (length - 1).bit_length() - 1
        self.run(n, symbol, half, before_run(symbol, length - half, after))
        self.run(n + half, symbol, length - half, after)

    def end(self, n: int, here: Vector) -> None:
        """What is inserted after the last row."""
        roles = ""
        while here[self.state]:
            roles += self.insert()
        self.out.append((n, roles, "", ""))


def cheapest_edits(starts: list[int], symbols: list[str], end: int) -> tuple[int, list[tuple[int, str, str, str]]]:
    """(cost, choices) for runs of equal symbols that start at rows ``starts``; ``end`` is the row after the last.

    The first choices in order of their letters, of all that cost least. A choice
    stands for all rows until the next one; the last, of row ``end``, has insertions only.
    """
    lengths = [b - a for a, b in zip(starts, starts[1:] + [end])]
    costs = [before(insertions(), (0, NEVER, NEVER, 0))]
    for symbol, length in zip(reversed(symbols), reversed(lengths)):
        costs.append(before_run(symbol, length, costs[-1]))
    costs.reverse()
    made = Unroll()
    for n, symbol, length, after in zip(starts, symbols, lengths, costs[1:]):
        made.run(n, symbol, length, after)
    made.end(end, costs[-1])
    return costs[0][START], made.out


# -- In Spark --------------------------------------------------------------------------------------------------------

SPACE, TOLD = r"[ \t-\r]", r"[^ \t-\r]"
#: Kinds of a row's first fault.
FAULTS = ("blank", "duplicate", "truncated")


def or_space(x: str) -> Column:
    return F.coalesce(F.col(x).cast("string"), F.lit(" "))


def damaged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text): ``rows`` with faults by crc32 of ``conv_id:turn`` modulo 20, as for a test of a repair.

    0 drops a row, 1 empties its text, 2 removes its ``.``, ``!`` and ``?``, 3
    repeats it, 4 makes it the user's. A null is read as one space.
    """
    way = F.crc32(F.concat(or_space(conv_id), F.lit(":"), or_space(turn))) % 20
    text_ = F.when(way == 1, "").when(way == 2, F.regexp_replace(or_space(text), "[.!?]", "")).otherwise(or_space(text))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(way == 0, 0).when(way == 3, 2).otherwise(1)))
    out = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.when(way == 4, "user").otherwise(or_space(role)).alias("role"), text_.alias("text"), copies.alias("_copy"))
    return out.drop("_copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with ``fault``, the first of FAULTS that a row has, else null, and ``n``, its place from 1.

    Rows of a conversation go by turn, nulls first, then by role and text. Rows
    with a role and a text seen earlier are found by a hash of both, of 128 bits.
    ``begins`` says where a run of equal ``symbol`` starts; ``illegal`` where a row
    may not follow the one before it.
    """
    said = (F.xxhash64("role", "text").alias("_a"), F.xxhash64(F.lit(11), "role", "text").alias("_b"))
    seen = Window.partitionBy("conv_id", "_a", "_b").orderBy(F.asc_nulls_first("turn"))
    # Dealt by conversation once, for both windows: the first one's keys include the second's.
    rows = rows.select("conv_id", "turn", "role", "text", *said).repartition("conv_id").withColumn("_seen", F.row_number().over(seen) > 1)
    last = F.substring(F.regexp_replace("text", f"{SPACE}+$", ""), -1, 1)
    fault = F.when(~F.col("text").rlike(TOLD), FAULTS[0]).when(F.col("_seen"), FAULTS[1]).when(~last.isin(".", "!", "?"), FAULTS[2])
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("-")
    rows = rows.withColumns({"fault": fault, "_initial": initial}).withColumn("symbol", F.when(F.col("fault").isin(*FAULTS[:2]), "x").otherwise(F.concat(known, F.when(F.col("fault").isNotNull(), "t").otherwise(""))))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text", "_seen")
    pair = F.concat(F.lag("_initial").over(order), "_initial")
    rows = rows.withColumns(
        {"n": F.row_number().over(order).cast("long"), "begins": ~F.col("symbol").eqNullSafe(F.lag("symbol").over(order)), "illegal": F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False))}
    )
    return rows.select("conv_id", "n", "turn", "role", "text", "fault", "symbol", "begins", "illegal")


def in_order(rows: DataFrame, *by: str) -> DataFrame:
    """Each conversation's rows in one task, in order: they are streamed there, never held."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *by)


def decide(marks: DataFrame) -> DataFrame:
    """(conv_id, n, inserted, edit, given, cost) from (conv_id, n, symbol): where runs begin, and where a conversation ends, without a symbol.

    A task keeps the runs of one conversation at a time: a number and a symbol each.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, symbols = [], []
        for batch in batches:
            out = []
            for conv, n, symbol in zip(*(c.to_pylist() for c in batch.columns)):
                if symbol is not None:
                    starts.append(n)
                    symbols.append(symbol)
                    continue
                cost, made = cheapest_edits(starts, symbols, n)
                out += [(conv, *x, cost if x[0] == n else None) for x in made]
                starts, symbols = [], []
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out) if out else [[]] * 6, schema)], schema=schema)

    kind = marks.schema["conv_id"].dataType
    out = f"conv_id {kind.simpleString()}, n long, inserted string, edit string, given string, cost long"
    schema = arrow_schema(marks.sparkSession, out)
    return in_order(marks.select("conv_id", "n", "symbol"), "n").mapInArrow(run, out)


def arrow_schema(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) of ``with_faults``'s rows (staged).

    turns: (conv_id, n, at, edit, role, text), every edit in order of n and at; a
    deleted row has its own role and text, an inserted one an empty text.
    conversations: (conv_id, gaps, blank, duplicate, truncated, illegal, cost).
    """
    counts = rows.groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"), *(F.count_if(F.col("fault") == f).alias(f) for f in FAULTS), F.count_if("illegal").alias("illegal"), F.max("n").alias("_n")
    )
    counts = materialize(counts.withColumn("gaps", F.coalesce("gaps", F.lit(0)).cast("long")), "conversations", narrow=True)
    marks = rows.where("begins").select("conv_id", "n", "symbol").union(counts.select("conv_id", F.col("_n") + 1, F.lit(None).cast("string")))
    made = materialize(decide(marks), "edits")
    cost = made.where("cost is not null").select(F.col("conv_id").alias("_conv"), "cost")
    conversations = counts.drop("_n").join(cost, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    # A choice stands before the rows that it is for; the last one of a conversation is a row of its own.
    choice = F.struct("inserted", "edit", "given")
    none = F.lit(None).cast("string")
    asked = made.select("conv_id", "n", F.lit(0).alias("kind"), choice.alias("choice"), F.col("cost").isNotNull().alias("ends"), none.alias("role"), none.alias("text"))
    own = rows.select("conv_id", "n", F.lit(1).alias("kind"), F.lit(None).cast("struct<inserted:string,edit:string,given:string>").alias("choice"), F.lit(False).alias("ends"), "role", "text")
    latest = F.last("choice", ignorenulls=True).over(Window.partitionBy("conv_id").orderBy("n", "kind").rowsBetween(Window.unboundedPreceding, 0))
    chosen = asked.union(own).withColumn("c", latest).where("kind = 1 or ends")
    named = lambda letter: F.when(letter == "u", "user").otherwise("assistant")
    letters = F.filter(F.split("c.inserted", ""), lambda x: x != "")
    line = lambda edit, role, text: F.struct(edit.alias("edit"), role.alias("role"), text.alias("text"))
    inserted = F.transform(letters, lambda x: line(F.lit("I"), named(x), F.lit("")))
    kept = F.when(F.col("kind") == 1, F.array(line(F.col("c.edit"), F.when(F.col("c.edit") == "R", named(F.col("c.given"))).otherwise(F.col("role")), F.col("text"))))
    every = F.concat(inserted, F.coalesce(kept, F.array().cast("array<struct<edit:string,role:string,text:string>>")))
    turns = chosen.select("conv_id", "n", F.posexplode(every).alias("at", "t")).select("conv_id", "n", "at", "t.edit", "t.role", "t.text")
    return turns, conversations


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256): the edits' letters, and the hash of the turns that are left, as ``role:text`` by lines.

    ``turns`` is what ``repair`` returns, so a conversation's rows are in one task already; texts stream through the hash.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, audit, sha, lines = None, [], None, 0
        for batch in batches:
            out = []
            for conv, edit, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4, 5))):
                if sha is None or conv != current:
                    if sha is not None:
                        out.append((current, "".join(audit), sha.hexdigest()))
                    current, audit, sha, lines = conv, [], hashlib.sha256(), 0
                audit.append(edit)
                if edit != "D":
                    sha.update(("\n" if lines else "").encode() + f"{role}:{text}".encode())
                    lines += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out) if out else [[]] * 3, schema)], schema=schema)
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((current, "".join(audit), sha.hexdigest()), schema)], schema=schema)

    out = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, audit string, repaired_sha256 string"
    schema = arrow_schema(turns.sparkSession, out)
    return turns.select("conv_id", "n", "at", "edit", "role", "text").sortWithinPartitions("conv_id", "n", "at").mapInArrow(run, out)


def repair_conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation of ``rows``: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    Nulls of role and text are read as one space; rows without a conversation are
    one conversation; rows without a turn come first; rows of one turn go by role
    and text. Other columns are left behind. An empty table gives no rows.

    Each conversation's symbols, then its edits, pass through one task in
    order, as its hash needs; texts stream or spill there, and only runs and edits are kept.
    """
    own = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), or_space(role).alias("role"), or_space(text).alias("text"))
    read = materialize(with_faults(own), "turns")
    turns, conversations = repair(read)
    said = digests(turns).withColumnRenamed("conv_id", "_conv")
    return conversations.join(said, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
