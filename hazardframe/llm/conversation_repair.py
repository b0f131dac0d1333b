"""Repair of conversations: faults of rows, and the cheapest edits to a legal order of roles.

Rows are sorted once into ranges of (conv_id, turn, role, text). A task walks through its range
and settles each conversation that surely lies inside it (``auction``). What touches the ends of
a range, or has more than ``BLOCK`` rows, is set aside: its rows are numbered and cut into blocks,
whatever conversation they belong to, so a conversation of any size is spread over the cluster. Parts of
a conversation are priced block by block, joined in groups level by level, and traced back the same way.
Only the digest of one conversation's text is one stream, since a hash is.

Defined cases: a null role or text counts as one space; a null turn sorts first and is ignored by
``gaps``; rows of a null conv_id form one conversation of that id; rows of the same turn
are taken by role and text; repeated rows are duplicates; an empty table gives no rows; further
columns are ignored, whatever their names. A role's initial is its first character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardframe.llm import auction
from hazardframe.llm.ordering import ranked, sorted_ranges
from hazardframe.operators.common import is_empty, materialise, small

#: Rows that a task holds of one conversation at most; parts that are joined in one group at most.
BLOCK = 4096
#: Rows in an Arrow batch of results.
_OUT = 2000
_WHITE = " \t\n\x0b\x0c\r"
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ROWS = "conv_id long, place long, edit string, role string, text string"
_ASIDE = "turn long, own_role string, own_text string, gone boolean, aside boolean"
_EMPTY = hashlib.sha256(b"").hexdigest()
_LEGAL = {"su", "ua", "au"}


def rows_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) with nulls in role and text as one space."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), F.lit(False).alias("gone"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in by the checksum of ``conv_id:turn``; a dropped row stays as a mark (``gone``).

    Nulls in the checked key count as one space, as they do in role and text.
    """
    rows = rows_of(conversations)
    key = F.concat(*[x for c in ("conv_id", "turn") for x in (F.coalesce(F.col(c).cast("string"), F.lit(" ")), F.lit(":"))][:-1])
    kind = F.crc32(key) % 20
    rows = rows.withColumn("_k", kind)
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("_k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("_k") == 0).alias("gone"), "_k")
    return rows.withColumn("_n", F.explode(F.sequence(F.lit(1), F.when(F.col("_k") == 3, 2).otherwise(1)))).drop("_k", "_n")


def report(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conversation (``REPORT``) from rows as ``rows_of`` or ``damaged`` gives them."""
    return _repair(rows, False, block)


def repaired(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The repaired rows (``ROWS``): place from 0, the edit that made the row (K, R or I), role and text."""
    return _repair(rows, True, block)


class Conversation:
    """Rows of one conversation in order, as they come."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.turns: list = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.marks = 0  # dropped rows

    def add(self, turn, role, text, gone) -> None:
        if gone:
            self.marks += 1
            return
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)

    def __len__(self) -> int:
        return len(self.roles) + self.marks

    def faults(self) -> tuple[str, list[int]]:
        """Signs of the rows, and how many are blank, duplicate and truncated."""
        seen, signs, count = set(), [], [0, 0, 0]
        for role, text in zip(self.roles, self.texts):
            end = text.rstrip(_WHITE)
            again = (role, text) in seen
            seen.add((role, text))
            kind = 0 if not end else 1 if again else 2 if end[-1] not in ".!?" else None
            if kind is not None:
                count[kind] += 1
            signs.append(auction.sign(role[:1], kind in (0, 1), kind == 2))
        return "".join(signs), count

    def counts(self) -> list[int]:
        turns = [t for t in self.turns if t is not None]
        gaps = turns[-1] - turns[0] + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for r in self.roles]
        illegal = sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:]))
        return [gaps, illegal]

    def edited(self, audit: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the rows after the edits."""
        return apply(audit, zip(self.roles, self.texts), auction.NOTHING)

    def digest(self) -> tuple:
        signs, (blank, duplicate, truncated) = self.faults()
        gaps, illegal = self.counts()
        cost, audit = auction.solve(signs)
        said = "\n".join(f"{r}:{t}" for _, r, t in self.edited(audit))
        return self.conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest()


def apply(audit: str, rows, state: int) -> Iterator[tuple[str, str, str]]:
    """Rows that remain after edits which start in a state."""
    rows = iter(rows)
    for edit in audit:
        if edit == "I":
            yield edit, auction.WANTED[state], ""
            state = auction.AFTER[state]
            continue
        role, text = next(rows)
        if edit == "K":
            yield edit, role, text
            state = auction.KEPT[state][role[:1]]
        elif edit == "R":
            yield edit, auction.WANTED[state], text
            state = auction.AFTER[state]


def _order() -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*[b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone")])


class _Out:
    """Result rows gathered into batches of one schema."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows = schema, []

    def add(self, row: tuple) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        if len(self.rows) >= _OUT:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = zip(*rows) if rows else [[] for _ in self.schema]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def _results(c: Conversation, texts: bool) -> Iterator[tuple]:
    if not texts:
        yield c.digest()
        return
    _, audit = auction.solve(c.faults()[0])
    for i, (edit, role, text) in enumerate(c.edited(audit)):
        yield c.conv_id, i, edit, role, text


def _settled_or_aside(batches: Iterator[pa.RecordBatch], texts: bool, cut: int) -> Iterator[pa.RecordBatch]:
    """Results of the conversations inside a sorted range, rows of the others.

    With ``cut``, the first and last conversation may go on in other ranges; they and those of ``cut`` rows and more go aside.
    """
    ddl = ROWS if texts else REPORT
    width = len(ddl.split(", "))
    out = _Out(_arrow(f"{ddl}, {_ASIDE}" if cut else ddl))
    own, first, tail = None, True, (None,) * 4 + (False,) if cut else ()

    def aside(c: Conversation):
        rows = [(c.conv_id, *(None,) * (width - 1), t, r, x, False, True) for t, r, x in zip(c.turns, c.roles, c.texts)]
        return rows + [(c.conv_id, *(None,) * (width - 1), None, None, None, True, True)] * c.marks

    flowing = False  # rows of a long conversation pass through
    for conv_id, turn, role, text, gone in _read(batches):
        if own is None or own.conv_id != conv_id:
            if own is not None:
                for row in aside(own) if cut and (first or flowing) else (r + tail for r in _results(own, texts)):
                    yield from out.add(row)
                first = False
            own, flowing = Conversation(conv_id), False
        own.add(turn, role, text, gone)
        if cut and len(own) >= cut:
            flowing = True
            for row in aside(own):
                yield from out.add(row)
            own = Conversation(conv_id)
    if own is not None:
        for row in aside(own) if cut else _results(own, texts):
            yield from out.add(row)
    yield out.flush()


def _repair(rows: DataFrame, texts: bool, block: int) -> DataFrame:
    ddl = ROWS if texts else REPORT
    names = [x.split()[0] for x in ddl.split(", ")]
    ranged = sorted_ranges(rows.select("conv_id", "turn", "role", "text", "gone"), _order())
    first = materialise(ranged.mapInArrow(lambda batches: _settled_or_aside(batches, texts, block), f"{ddl}, {_ASIDE}"), "settled")
    done = first.filter("NOT aside").select(*names)
    aside = first.filter("aside").select("conv_id", "turn", F.col("own_role").alias("role"), F.col("own_text").alias("text"), "gone")
    if is_empty(aside):
        return done
    placed = _blocks(aside, block)
    bounds = placed.groupBy("conv_id").agg(F.min("block").alias("_lo"), F.max("block").alias("_hi"))
    bounds = small(materialise(bounds, "bounds"))
    placed = placed.join(bounds, placed["conv_id"].eqNullSafe(bounds["conv_id"])).drop(bounds["conv_id"])
    short = placed.filter("_lo = _hi").repartition("block").sortWithinPartitions("block", "rank")
    done = done.unionByName(short.select("conv_id", "turn", "role", "text", "gone").mapInArrow(lambda batches: _settled_or_aside(batches, texts, 0), ddl))
    long = placed.filter("_lo < _hi").drop("_lo", "_hi")
    return done if is_empty(long) else done.unionByName(_spread(materialise(long, "long"), texts, block))


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """Rows in order with their ``rank`` (from 0) and ``block`` of at most so many ranks."""
    return ranked(rows, _order()).withColumn("block", F.floor(F.col("rank") / block))


# Conversations over several blocks


def _flags(long: DataFrame) -> DataFrame:
    """Rows with their fault and sign; the first of equal rows is found by a count per text, not per conversation."""
    rows = long.filter("NOT gone").withColumn("_h", F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256))
    again = rows.groupBy("conv_id", "_h").agg(F.min("rank").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    again = small(materialise(again.drop("_n"), "again"))
    rows = rows.join(again, rows["conv_id"].eqNullSafe(again["conv_id"]) & (rows["_h"] == again["_h"]), "left").drop(again["conv_id"]).drop("_h")
    end = F.rtrim(F.translate("text", _WHITE, " " * len(_WHITE)))
    fault = F.when(end == "", "blank").when(F.col("rank") > F.col("_first"), "duplicate").when(~F.substring(end, -1, 1).isin(".", "!", "?"), "truncated")
    rows = rows.withColumn("fault", fault).drop("_first")
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    gone = F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False))
    return rows.withColumn("sign", F.when(gone, "d").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter))


_COST = "conv_id long, place long, cost array<long>, rank_of array<int>"
_WAY = "conv_id long, place long, enter int, leave int"


def _priced(signs: pa.Table) -> pa.Table:
    """The part of one conversation's rows in one block."""
    part = auction.part_of("".join(signs.sort_by("rank").column("sign").to_pylist()))
    return _cost_row(signs, "block", part)


def _joined(parts: pa.Table) -> pa.Table:
    """The part of up to ``BLOCK`` consecutive parts."""
    return _cost_row(parts, "above", auction.Tree(_parts(parts)).top)


def _parts(parts: pa.Table) -> list[auction.Part]:
    parts = parts.sort_by("place")
    return [auction.Part(c, o) for c, o in zip(parts.column("cost").to_pylist(), parts.column("rank_of").to_pylist())]


def _cost_row(source: pa.Table, place: str, part: auction.Part) -> pa.Table:
    return pa.table({"conv_id": source.column("conv_id").slice(0, 1), "place": source.column(place).slice(0, 1), "cost": pa.array([part.cost], pa.list_(pa.int64())), "rank_of": pa.array([part.order], pa.list_(pa.int32()))})


def _ways(parts: pa.Table) -> pa.Table:
    """States before and after each of the parts whose joined way is known."""
    parts = parts.sort_by("place")
    ends = auction.Tree(_parts(parts)).ends(parts.column("enter")[0].as_py(), parts.column("leave")[0].as_py())
    return pa.table({"conv_id": parts.column("conv_id"), "place": parts.column("place"), "enter": pa.array([a for a, _ in ends], pa.int32()), "leave": pa.array([b for _, b in ends], pa.int32())})


def _final(parts: pa.Table) -> pa.Table:
    (part,) = _parts(parts)
    cost, b = auction.close(part)
    return pa.table({"conv_id": parts.column("conv_id"), "place": parts.column("place"), "enter": pa.array([auction.NOTHING], pa.int32()), "leave": pa.array([b], pa.int32()), "cost": pa.array([cost], pa.int64())})


def _traced(rows: pa.Table) -> pa.Table:
    """Edits of the rows of one conversation in one block, up to and with each row."""
    rows = rows.sort_by("rank")
    a, b = rows.column("enter")[0].as_py(), rows.column("leave")[0].as_py()
    edits, states, own, state, before = [], [], "", a, a
    initials = iter(rows.column("role").to_pylist())
    for edit in auction.trace("".join(rows.column("sign").to_pylist()), a, b):
        own += edit
        if edit == "I":
            state = auction.AFTER[state]
            continue
        initial = next(initials)[:1]
        state = auction.KEPT[state][initial] if edit == "K" else auction.AFTER[state] if edit == "R" else state
        edits.append(own)
        states.append(before)
        own, before = "", state
    return pa.table({"conv_id": rows.column("conv_id"), "rank": rows.column("rank"), "edits": pa.array(edits, pa.string()), "state": pa.array(states, pa.int32())})


def _spread(long: DataFrame, texts: bool, block: int) -> DataFrame:
    """Results of conversations of any length; ``long`` has rank, block and whole rows."""
    flags = materialise(_flags(long).select("conv_id", "rank", "block", "turn", "role", "fault", "sign"), "flags")
    levels = [materialise(flags.select("conv_id", "rank", "block", "sign").groupBy("conv_id", "block").applyInArrow(_priced, _COST), "parts")]
    # Numbers of blocks are cut to numbers of groups of blocks until each conversation is one part.
    while not is_empty(levels[-1].groupBy("conv_id").count().filter("count > 1")):
        above = levels[-1].withColumn("above", F.floor(F.col("place") / block))
        levels.append(materialise(above.groupBy("conv_id", "above").applyInArrow(_joined, _COST), "parts"))
    final = materialise(levels[-1].groupBy("conv_id").applyInArrow(_final, f"{_WAY}, cost long"), "final")
    way = final.drop("cost")
    for level in reversed(levels[:-1]):
        below = level.withColumn("above", F.floor(F.col("place") / block))
        known = way.select(F.col("conv_id").alias("_c"), F.col("place").alias("_p"), "enter", "leave")
        below = below.join(known, below["conv_id"].eqNullSafe(F.col("_c")) & (F.col("above") == F.col("_p"))).drop("_c", "_p")
        way = materialise(below.groupBy("conv_id", "above").applyInArrow(_ways, _WAY), "ways")
    known = way.select(F.col("conv_id").alias("_c"), F.col("place").alias("block"), "enter", "leave")
    rows = flags.alias("f").join(known.alias("w"), F.col("f.block").eqNullSafe(F.col("w.block")) & F.col("f.conv_id").eqNullSafe(F.col("_c")))
    rows = rows.select("f.conv_id", "f.block", "rank", "role", "sign", "enter", "leave")
    edits = rows.groupBy("conv_id", "block").applyInArrow(_traced, "conv_id long, rank long, edits string, state int").drop("conv_id")
    ends = small(final.select(F.col("conv_id").alias("_c"), "leave", "cost"))
    full = long.join(edits, "rank", "left").join(flags.select("rank", "fault"), "rank", "left")
    full = full.join(ends, full["conv_id"].eqNullSafe(ends["_c"]), "left").drop("_c", "block").fillna(0, ["leave", "cost"])  # no rows are left of some
    if texts:
        return _streamed(full, _edited_rows, ROWS)
    return _streamed(full, _reports, REPORT)


def _streamed(full: DataFrame, walk, ddl: str) -> DataFrame:
    """Each conversation's rows as one sorted stream; nothing of it is kept but counts and edits."""
    return full.repartition("conv_id").sortWithinPartitions("conv_id", "rank").mapInArrow(walk, ddl)


_FULL = ("conv_id", "turn", "role", "text", "gone", "edits", "state", "fault", "leave", "cost")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, dict]]:
    """(is the first row of its conversation, row)."""
    before = ()
    for b in batches:
        for values in zip(*[b.column(c).to_pylist() for c in _FULL]):
            row = dict(zip(_FULL, values))
            yield before != (row["conv_id"],), row
            before = (row["conv_id"],)


def _edited_rows(batches):
    out, last, place = _Out(_arrow(ROWS)), None, 0

    def closing(row, place):
        for i, (edit, role, text) in enumerate(apply(auction.CLOSING[row["leave"]], (), row["leave"])):
            yield row["conv_id"], place + i, edit, role, text

    for first, row in _grouped(batches):
        if first:
            for x in closing(last, place) if last else ():
                yield from out.add(x)
            place = 0
        last = row
        if not row["gone"]:
            for edit, role, text in apply(row["edits"], [(row["role"], row["text"])], row["state"]):
                yield from out.add((row["conv_id"], place, edit, role, text))
                place += 1
    for x in closing(last, place) if last else ():
        yield from out.add(x)
    yield out.flush()


class _Running:
    """A report in the making."""

    def __init__(self, row):
        self.row, self.hash, self.audit, self.any = row, hashlib.sha256(), [], False
        self.count = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.turns, self.low, self.last, self.initial = 0, None, None, None

    def say(self, rows) -> None:
        for _, role, text in rows:
            self.hash.update((("\n" if self.any else "") + f"{role}:{text}").encode())
            self.any = True

    def add(self, row) -> None:
        if row["gone"]:
            return
        self.row = row
        if row["fault"]:
            self.count[row["fault"]] += 1
        if row["turn"] is not None and row["turn"] != self.last:
            self.turns, self.last = self.turns + 1, row["turn"]
            self.low = row["turn"] if self.low is None else self.low
        initial = row["role"][:1]
        if self.initial is not None and self.initial + initial not in _LEGAL:
            self.count["illegal"] += 1
        self.initial = initial
        self.audit.append(row["edits"])
        self.say(apply(row["edits"], [(row["role"], row["text"])], row["state"]))

    def result(self) -> tuple:
        leave, c = self.row["leave"], self.count
        self.say(apply(auction.CLOSING[leave], (), leave))
        gaps = self.last - self.low + 1 - self.turns if self.turns else 0
        return (self.row["conv_id"], gaps, c["blank"], c["duplicate"], c["truncated"], c["illegal"], self.row["cost"], "".join(self.audit) + auction.CLOSING[leave], self.hash.hexdigest())


def _reports(batches):
    out, own = _Out(_arrow(REPORT)), None
    for first, row in _grouped(batches):
        if first:
            if own is not None:
                yield from out.add(own.result())
            own = _Running(row)
        own.add(row)
    if own is not None:
        yield from out.add(own.result())
    yield out.flush()
