"""Conversation repair: the cheapest edits that make a conversation's roles legal, by weighted CYK parsing over spans of turns.

Legal role initials are `(s?(ua)+)?`. The repair grammar is in Chomsky normal form. A nonterminal (p, q) covers a span of turns
that takes a legal conversation from point p to point q (points: before all, after the system turn, after a user turn, after an
assistant turn). A turn is a terminal: kept, given another role or deleted; inserted turns need no terminal, so every cell is
closed under insertions on both sides. Binary rules are (p, q) -> (p, r) (r, q). A cell has the least (cost, audit) of its span
for each nonterminal. As those rules exist for every r, each parse can be bracketed anew at any place of its span, so one split
of a span finds its minimum: spans double in length from one turn to the whole conversation, bottom-up.

Costs are sums over the letters of an audit and the turns they stand for, so no audit of a cell is the beginning of another of
equal cost, and the least audit of a span joins the least audits of its parts.

Rows are ordered once, by a range sort of (conversation, turn, role, text). Runs of turns of one conversation are parsed where
they lie, and the cells of runs in several partitions are combined afterwards, so a conversation may be larger than a task.
The last pass walks the turns of a conversation in order, as a stream beside its audit; the digest of a whole conversation
can't be split (SHA-256 is serial), but its task keeps only an Arrow batch and one letter a turn.

Defined cases: null roles and texts are one space; null turns come first; null conversation ids are one conversation; rows that
share a turn are ordered by role and text; a role without an initial of s, u or a can't be kept; repeated rows are duplicates;
an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litlens.llm.common import checkpoint, partitions, read_table
from litlens.llm.words import slices

#: Points of a legal conversation, and the initials that lead from one to the next.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Where a conversation may end.
FINAL = ((EMPTY, EMPTY), (EMPTY, ASSISTANT))
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: [\x20\x09-\x0D]
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: Spans of so many turns or fewer are remembered: there are few kinds of turns, and most conversations are short.
REMEMBERED = 16

Cell = dict[tuple[int, int], tuple[int, str]]


def better(cell: Cell, pair: tuple[int, int], cost: int, audit: str) -> None:
    if pair not in cell or (cost, audit) < cell[pair]:
        cell[pair] = cost, audit


def combine(left: Cell, right: Cell) -> Cell:
    """(p, q) -> (p, r) (r, q) for two spans beside each other."""
    out: Cell = {}
    for (p, r), (c, x) in left.items():
        for (r2, q), (d, y) in right.items():
            if r == r2:
                better(out, (p, q), c + d, x + y)
    return out


def _insertions() -> Cell:
    """The empty span: turns that are inserted."""
    cell: Cell = {(p, p): (0, "") for p in (EMPTY, SYSTEM, USER, ASSISTANT)}
    one = cell | {(p, q): (INSERT, "I") for (p, i), q in STEPS.items() if i in ROLES and (p, q) not in cell}
    while (more := combine(cell, one)) != cell:
        cell = more
    return cell


INSERTED = _insertions()


def kind(initial: str, fault: str | None) -> str:
    """One letter for what the grammar knows of a turn: its initial (x: none of s, u, a), upper-case if truncated; d: must go."""
    if fault in ("blank", "duplicate"):
        return "d"
    letter = initial if initial and initial in "sua" else "x"
    return letter.upper() if fault == "truncated" else letter


@lru_cache
def turn_cell(k: str) -> Cell:
    """One turn, closed under insertions on both sides."""
    cell: Cell = {(p, p): (DELETE, "D") for p in (EMPTY, SYSTEM, USER, ASSISTANT)}
    if k != "d":
        more = TRUNCATED if k.isupper() else 0
        for (p, i), q in STEPS.items():
            if i == k.lower():
                better(cell, (p, q), KEEP + more, "K")
            elif i in ROLES:
                better(cell, (p, q), REROLE + more, "R")
    return combine(combine(INSERTED, cell), INSERTED)


@lru_cache(maxsize=1 << 16)
def _short(kinds: str) -> Cell:
    if len(kinds) == 1:
        return turn_cell(kinds)
    half = 1 << (len(kinds) - 1).bit_length() - 1
    return combine(_short(kinds[:half]), _short(kinds[half:]))


def parse(kinds: str) -> Cell:
    """The cell of a span of turns, bottom-up by span length."""
    cells = [_short(kinds[i : i + REMEMBERED]) for i in range(0, len(kinds), REMEMBERED)] or [INSERTED]
    while len(cells) > 1:
        cells = [combine(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


def best(cell: Cell) -> tuple[int, str]:
    return min(cell[x] for x in FINAL if x in cell)


# Spark


def damage(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text) with faults that the key of each row decides (the query's contract)."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(name(conv), F.lit(":"), name(turn))) % 20
    rows = conversations.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), name(role).alias("role"), name(text).alias("text"), case.alias("case")).filter("case <> 0")
    rows = rows.withColumn("text", F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("case") == 4, "user").otherwise(F.col("role")))
    return rows.select("conv", "turn", "role", "text", F.explode(F.when(F.col("case") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


def ordered(rows: DataFrame) -> DataFrame:
    """rows (conv, turn, role, text) with `at`: increasing numbers in the order of conversations and turns, as a table."""
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())  # repeated rows may lie in several partitions
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first(), F.col("_tie")]
    return checkpoint(rows.repartitionByRange(partitions(rows), *order).sortWithinPartitions(*order).drop("_tie").withColumn("at", F.monotonically_increasing_id()))


def faults(placed: DataFrame) -> DataFrame:
    """(conv, turn, initial, at, fault) of placed: the first fault of each row, or null. The first row of a role and text is a
    minimum, not a window: equal rows may be a third of the table."""
    first = placed.groupBy("conv", "role", "text").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("is_first"))
    solid: Column = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(solid == "", "blank").when(F.col("is_first").isNull(), "duplicate").when(~F.right(solid, F.lit(1)).isin(".", "!", "?"), "truncated")
    return placed.join(first, "at", "left").select("conv", "turn", F.substring("role", 1, 1).alias("initial"), "at", fault.alias("fault"))


COUNTS = ("blank", "duplicate", "truncated", "illegal")
CELL = T.ArrayType(T.StructType([T.StructField("p", T.IntegerType()), T.StructField("q", T.IntegerType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())]))


def _run_schema(conv: T.DataType) -> T.StructType:
    longs = ("at", "min_turn", "max_turn", "n_turns", *COUNTS)
    return T.StructType([T.StructField("conv", conv), *[T.StructField(c, T.LongType()) for c in longs], T.StructField("head", T.StringType()), T.StructField("tail", T.StringType()), T.StructField("cell", CELL)])


LEGAL = ("su", "ua", "au")


def _batches(rows: Iterator[dict], schema: pa.Schema, n: int = 500) -> Iterator[pa.RecordBatch]:
    while some := list(itertools.islice(rows, n)):
        yield pa.RecordBatch.from_pylist(some, schema=schema)


def _cell_rows(cell: Cell) -> list[dict]:
    return [{"p": p, "q": q, "cost": c, "audit": x} for (p, q), (c, x) in cell.items()]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """A row for each run of turns of one conversation, of turns in order."""
    turns = (r for batch in slices(batches) for r in batch.to_pylist())
    for conv, rows in itertools.groupby(turns, key=lambda r: r["conv"]):
        run = {"conv": conv, "at": None, "min_turn": None, "max_turn": None, "n_turns": 0, **dict.fromkeys(COUNTS, 0), "head": None, "tail": None}
        kinds = bytearray()  # one letter a turn, whatever its text
        for r in rows:
            if run["at"] is None:
                run |= {"at": r["at"], "head": r["initial"]}
            elif run["tail"] + r["initial"] not in LEGAL:
                run["illegal"] += 1
            run["tail"] = r["initial"]
            if r["fault"]:
                run[r["fault"]] += 1
            if r["turn"] is not None and r["turn"] != run["max_turn"]:
                run["min_turn"] = r["turn"] if run["min_turn"] is None else run["min_turn"]
                run["max_turn"], run["n_turns"] = r["turn"], run["n_turns"] + 1
            kinds += kind(r["initial"], r["fault"]).encode()
        yield run | {"cell": _cell_rows(parse(kinds.decode()))}


def _join(a: dict, b: dict) -> dict:
    """Two runs of one conversation, beside each other."""
    out = a | {c: a[c] + b[c] for c in COUNTS} | {"tail": b["tail"], "n_turns": a["n_turns"] + b["n_turns"]}
    out["illegal"] += a["tail"] + b["head"] not in LEGAL
    if b["min_turn"] is not None:
        out["n_turns"] -= a["max_turn"] == b["min_turn"]
        out |= {"min_turn": b["min_turn"] if a["min_turn"] is None else a["min_turn"], "max_turn": b["max_turn"]}
    return out | {"cell": combine(a["cell"], b["cell"])}


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The header of each conversation from its runs in order; its run without turns stands for having none."""
    runs = (r for batch in slices(batches) for r in batch.to_pylist())
    for conv, some in itertools.groupby(runs, key=lambda r: r["conv"]):
        stack: list[tuple[int, dict]] = []  # as in a binary counter: spans of about equal length meet
        empty = None
        for r in some:
            if r["head"] is None:
                empty = r
                continue
            r = r | {"cell": {(x["p"], x["q"]): (x["cost"], x["audit"]) for x in r["cell"]}}
            size = 1
            while stack and stack[-1][0] == size:
                r, size = _join(stack.pop()[1], r), size * 2
            stack.append((size, r))
        if not stack:
            yield {"conv": conv, "at": -1, "gaps": 0, **{c: empty[c] for c in COUNTS}, "cost": 0, "audit": ""}
            continue
        r = stack.pop()[1]
        while stack:
            r = _join(stack.pop()[1], r)
        cost, audit = best(r["cell"])
        gaps = 0 if r["min_turn"] is None else r["max_turn"] - r["min_turn"] + 1 - r["n_turns"]
        yield {"conv": conv, "at": -1, "gaps": gaps, **{c: r[c] for c in COUNTS}, "cost": cost, "audit": audit}


def audits(judged: DataFrame, every: DataFrame) -> DataFrame:
    """(conv, at = -1, gaps, blank, duplicate, truncated, illegal, cost, audit) for each conversation of every (conv)."""
    schema = _run_schema(judged.schema["conv"].dataType)
    head = T.StructType([schema["conv"], *[T.StructField(c, T.LongType()) for c in ("at", "gaps", *COUNTS, "cost")], T.StructField("audit", T.StringType())])
    arrow = _arrow(schema), _arrow(head)
    runs = judged.repartitionByRange(partitions(judged), "at").sortWithinPartitions("at").mapInArrow(lambda b: _batches(_runs(b), arrow[0]), schema)
    none = every.select("conv").distinct().select("conv", *[F.lit({"at": -1}.get(f.name, 0) if isinstance(f.dataType, T.LongType) else None).cast(f.dataType).alias(f.name) for f in schema.fields[1:]])
    both = runs.unionByName(none)
    return both.repartition(partitions(both), "conv").sortWithinPartitions("conv", "at").mapInArrow(lambda b: _batches(_whole(b), arrow[1]), head)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def replay(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(role, text, edit) of the repaired conversation, one after the other."""
    point, letters = EMPTY, iter(audit)
    for letter in letters:
        role, text = ("", "") if letter == "I" else next(turns)
        if letter == "D":
            continue
        initial = role[:1] if letter == "K" else "a" if point == USER else "u"
        yield (role if letter == "K" else ROLES[initial]), text, letter
        point = STEPS[point, initial]


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[tuple[str, str, str]]]]:
    """(header, repaired turns) of each conversation, streamed; the turns are to be used up before the next one."""
    rows = (r for batch in slices(batches) for r in batch.to_pylist())
    for _, some in itertools.groupby(rows, key=lambda r: r["conv"]):
        head = next(some)
        yield head, replay(head["audit"], ((r["role"], r["text"]) for r in some))


def _beside(placed: DataFrame, heads: DataFrame) -> DataFrame:
    """Each conversation's header, then its turns in order."""
    turns = placed.select("conv", "at", "role", "text")
    both = heads.unionByName(turns, allowMissingColumns=True)
    return both.repartition(partitions(both), "conv").sortWithinPartitions("conv", "at")


def repaired_turns(placed: DataFrame, heads: DataFrame) -> DataFrame:
    """(conv, place, role, text, edit) of the repaired conversations; place counts from 0."""
    schema = T.StructType([placed.schema["conv"], T.StructField("place", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("role", "text", "edit")]])
    arrow = _arrow(schema)

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(({"conv": h["conv"], "place": i, "role": role, "text": text, "edit": edit} for h, some in _replayed(batches) for i, (role, text, edit) in enumerate(some)), arrow)

    return _beside(placed, heads).mapInArrow(turns, schema)


def digests(placed: DataFrame, heads: DataFrame) -> DataFrame:
    """heads with repaired_sha256: of the repaired turns as role:text, joined by newlines."""
    schema = T.StructType([*heads.schema.fields, T.StructField("repaired_sha256", T.StringType())])
    arrow = _arrow(schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for head, some in _replayed(batches):
            sha = hashlib.sha256()
            for i, (role, text, _) in enumerate(some):
                sha.update(f"{chr(10) if i else ''}{role}:{text}".encode())
            yield {c: head[c] for c in schema.names[:-1]} | {"repaired_sha256": sha.hexdigest()}

    return _beside(placed, heads).mapInArrow(lambda b: _batches(digest(b), arrow), schema)


def repair(rows: DataFrame, every: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(turns in order with `at`, header of each conversation) of rows (conv, turn, role, text); every (conv) names
    conversations that may have no row."""
    placed = ordered(rows)
    return placed, checkpoint(audits(faults(placed), placed if every is None else every))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read_table(spark, sf_dir, "conversations")
    placed, heads = repair(damage(conversations), conversations.select(F.col("conv_id").alias("conv")))
    return digests(placed, heads).drop("at").withColumnRenamed("conv", "conv_id")
