"""Cheapest repair of conversations whose roles should read ``(s?(ua)+)?``.

Edits of a row, in order of the turns: Keep, Rerole to user or assistant, Delete;
and Insert of an empty user or assistant row anywhere.  The roles kept so far
put a conversation into one of four states (nothing, system, user, assistant),
so a run of rows is a 4 x 4 table: what it costs to go from one state to
another, and, among the ends of one start, the order of the least edit strings.
Such tables join like rows do, which gives Hirschberg's method at every size: a
run of rows is halved, the forward costs of the first half and the backward
costs of the second meet in a state (on equal cost that with the least edits
before it), and both halves are solved alike, in linear space.

Conversations are laid end to end in one order and cut into blocks of
``BLOCK`` rows.  One that lies within a block is solved there.  One that crosses
blocks gives a table per block; tables are joined in groups of ``FAN``, level by
level, and the states that halving finds between the tables are handed down
until every block knows the states at its ends.  No task holds more than
a block of rows, or a group of tables, of one conversation, however long it is.

Edit strings of the same rows end in a row's letter and have equally many of
those letters, so none begins another, and the least string of a whole is made of
least strings of its parts: orders within a part are all that a join needs.

Defined cases: null role and text count as one space, in the key of the damage
null id and turn do too; rows of the same turn go by role, then by the MD5 of the
text; a null ``conv_id`` is a conversation; repeated rows are duplicates; a role
counts by its first character (none: no role); a conversation without rows is
reported with zeros; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.registry import register
from cohortlens.llm.tables import read, stage
from cohortlens.operators.ranking import positions

BLOCK = 1024
FAN = 1024
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACES = " \t\n\x0b\x0c\r"

START, SYSTEM, USER, ASSISTANT = range(4)
#: (state, initial of the next role) -> state
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ROLE_OF = {"u": "user", "a": "assistant"}
INITIALS = "sua"
#: Kinds of rows: 0 has to go; then by initial (system, user, assistant, other) and whether truncated.
KINDS = 9
FAR = 1 << 60

#: A table: for each state before, (state after, cost, order among the states after).
Table = tuple[tuple[tuple[int, int, int], ...], ...]


def inserted_before(state: int) -> Iterator[tuple[int, str]]:
    """States that 0, 1, ... inserted rows lead to, each once, with the initials of the rows."""
    seen, roles = set(), ""
    while state not in seen:
        yield state, roles
        seen.add(state)
        roles += "a" if state == USER else "u"
        state = NEXT[state, roles[-1]]


def row_edits(kind: int) -> list[dict[int, tuple[int, str, str, str]]]:
    """For each state before a row: state after -> (cost, letters, roles inserted, new role's initial)
    of the cheapest, then least, edits of the row and the inserts right before it."""
    initial, late = (INITIALS + "-")[(kind - 1) // 2] if kind else "-", TRUNCATED * ((kind - 1) % 2) if kind else 0
    out = []
    for before in range(4):
        best: dict[int, tuple[int, str, str, str]] = {}
        for state, roles in inserted_before(before):
            options = [(state, DELETE, "D", "")]
            if kind:
                options += [(NEXT.get((state, initial)), late, "K", "")]
                options += [(NEXT.get((state, r)), late + REROLE, "R", r) for r in ROLE_OF]
            for after, cost, letter, role in options:
                if after is not None:
                    edit = (cost + INSERT * len(roles), "I" * len(roles) + letter, roles, role)
                    best[after] = min(best.get(after, edit), edit)
        out.append(best)
    return out


EDITS = [row_edits(k) for k in range(KINDS)]
#: Rows inserted after the last one, and their cost; FAR where no end is reached.
LAST = ["", "ua", "a", ""]
LAST_COST = [INSERT * len(r) for r in LAST]


def ordered(best: dict[int, tuple]) -> tuple[tuple[int, int, int], ...]:
    """(state after, cost, order): the order is that of the second entries."""
    order = sorted(best, key=lambda s: best[s][1])
    return tuple((s, best[s][0], order.index(s)) for s in sorted(best))


ROWS: list[Table] = [tuple(ordered(best) for best in edits) for edits in EDITS]


def forward(state: int, tables: Sequence[Table]) -> dict[int, tuple[int, int]]:
    """state after all tables -> (least cost from ``state``, order of its least edits)."""
    now = {state: (0, 0)}
    for table in tables:
        best: dict[int, tuple[int, tuple[int, int]]] = {}
        for s, (cost, order) in now.items():
            for after, more, own in table[s]:
                x = (cost + more, (order, own))
                if after not in best or x < best[after]:
                    best[after] = x
        now = {s: (c, o) for s, c, o in ordered(best)}
    return now


def backward(state: int, tables: Sequence[Table]) -> list[int]:
    """Least cost from each state before the tables to ``state`` after them."""
    now = [FAR] * 4
    now[state] = 0
    for table in reversed(tables):
        now = [min((more + now[after] for after, more, _ in table[s]), default=FAR) for s in range(4)]
    return now


def joined(tables: Sequence[Table]) -> Table:
    return tuple(tuple((s, c, o) for s, (c, o) in sorted(forward(before, tables).items())) for before in range(4))


def best_end(tables: Sequence[Table]) -> int:
    """The state after all tables on the cheapest, then least, way to an end of the pattern."""
    ends = forward(START, tables)
    return min(ends, key=lambda s: (ends[s][0] + LAST_COST[s], ends[s][1]))


def crossings(tables: Sequence[Table], before: int, after: int) -> list[int]:
    """States after each table on the best way from ``before`` to ``after``, by halving."""
    out = [after] * len(tables)
    open_ = [(0, len(tables), before, after)]
    while open_:
        lo, hi, first, last = open_.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        ahead, behind = forward(first, tables[lo:mid]), backward(last, tables[mid:hi])
        out[mid - 1] = meet = min(ahead, key=lambda s: (ahead[s][0] + behind[s], ahead[s][1]))
        open_ += [(lo, mid, first, meet), (mid, hi, meet, last)]
    return out


def solve(kinds: bytes, before: int = START, after: int | None = None) -> tuple[int, ...]:
    """States after each of the rows; without ``after`` the rows are a whole conversation."""
    tables = [ROWS[k] for k in kinds]
    return tuple(crossings(tables, before, best_end(tables) if after is None else after))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with the faults that the key ``conv_id:turn`` deals out."""
    def filled(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fault = F.pmod(F.crc32(F.concat_ws(":", filled("conv_id"), filled("turn")).cast("binary")), F.lit(20))
    return (rows.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), filled("role").alias("role"),
                        filled("text").alias("text"), fault.alias("_fault"))
            .filter("_fault != 0")
            .withColumns({"text": F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace("text", "[.!?]", ""))
                          .otherwise(F.col("text")),
                          "role": F.when(F.col("_fault") == 4, "user").otherwise(F.col("role")),
                          "_copy": F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))})
            .drop("_fault", "_copy"))


def laid_out(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows in one order, with their position and block; null role and text become a space."""
    rows = rows.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"),
                       *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    return positions(rows, ["conv_id", "turn", "role", F.md5("text")]).withColumn("block", F.floor(F.col("position") / block))


def with_faults(placed: DataFrame) -> DataFrame:
    """Per position: conv_id, block, turn, initial of the role, fault (blank, duplicate, truncated, null) and kind; no text."""
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    light = placed.select("conv_id", "position", "block", "turn", F.when(F.col("role") == "", "-").otherwise(F.left("role", F.lit(1))).alias("initial"),
                          (end == "").alias("_blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("_cut"),
                          "role", F.sha2("text", 256).alias("_text"))
    first = (light.filter("not _blank").groupBy("conv_id", "role", "_text").agg(F.min("position").alias("position"))
             .select("position", F.lit(True).alias("_first")))
    fault = (F.when(F.col("_blank"), "blank").when(F.col("_first").isNull(), "duplicate").when(F.col("_cut"), "truncated"))
    number = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in INITIALS]), F.col("initial")), F.lit(0))
    kind = (F.when(F.col("fault").isin("blank", "duplicate"), 0)
            .otherwise(F.lit(1) + 2 * F.pmod(number - 1, F.lit(4)) + F.when(F.col("fault") == "truncated", 1).otherwise(0)))
    return (light.join(first, "position", "left").withColumn("fault", fault).withColumn("kind", kind.cast("int"))
            .select("conv_id", "position", "block", "turn", "initial", "fault", "kind"))


def _segments(table: pa.Table) -> Iterator[tuple[int, int, int | None]]:
    """(first row, end, conv_id) of each conversation in a block's rows, which are in order."""
    ids = table.column("conv_id").to_pylist()
    at = 0
    for i in range(1, len(ids) + 1):
        if i == len(ids) or ids[i] != ids[at]:
            yield at, i, ids[at]
            at = i


def _flat(table: Table) -> list[int]:
    """16 costs and 16 orders; FAR and 0 where a state is not reached."""
    cost, order = [FAR] * 16, [0] * 16
    for s, row in enumerate(table):
        for after, c, o in row:
            cost[4 * s + after], order[4 * s + after] = c, o
    return cost + order


def _table(flat: Sequence[int]) -> Table:
    return tuple(tuple((a, flat[4 * s + a], flat[16 + 4 * s + a]) for a in range(4) if flat[4 * s + a] < FAR) for s in range(4))


def block_tables(faults: DataFrame) -> DataFrame:
    """(conv_id, at, flat): the joined table of the first and of the last conversation
    of every block, the only ones that other blocks may hold rows of."""
    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("position")
        kinds, parts = bytes(block.column("kind").to_pylist()), list(_segments(block))
        ends = parts[:1] + parts[1:][-1:]
        at = block.column("block")[0].as_py()
        return pa.table({"conv_id": pa.array([c for *_, c in ends], pa.int64()), "at": pa.array([at] * len(ends), pa.int64()),
                         "flat": pa.array([_flat(joined([ROWS[k] for k in kinds[a:b]])) for a, b, _ in ends], pa.list_(pa.int64()))})

    return (faults.select("conv_id", "position", "block", "kind").groupBy("block")
            .applyInArrow(run, "conv_id bigint, at bigint, flat array<bigint>"))


_ENDS = "conv_id bigint, at bigint, before int, after int, last boolean"


def table_ends(tables: DataFrame, fan: int = FAN) -> DataFrame:
    """(conv_id, at, before, after, last): the states around each table on the best
    way through its conversation, whose tables are in the order of ``at``."""
    def given(group: pa.Table, before: int, after: int | None, ends: bool) -> pa.Table:
        own = [_table(f) for f in group.column("flat").to_pylist()]
        states = crossings(own, before, best_end(own) if after is None else after)
        last = [False] * (len(own) - 1) + [ends]
        return pa.table({"conv_id": group.column("conv_id").cast(pa.int64()), "at": group.column("at").cast(pa.int64()),
                         "before": pa.array([before, *states[:-1]], pa.int32()), "after": pa.array(states, pa.int32()), "last": last})

    def whole(group: pa.Table) -> pa.Table:
        return given(group.sort_by("at"), START, None, True)

    def within(group: pa.Table) -> pa.Table:
        return given(group.sort_by("at"), *[group.column(c)[0].as_py() for c in ("before", "after", "last")])

    def join(group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        flat = _flat(joined([_table(f) for f in group.column("flat").to_pylist()]))
        return pa.table({"conv_id": group.column("conv_id").slice(0, 1).cast(pa.int64()), "at": group.column("up").slice(0, 1).cast(pa.int64()),
                         "flat": pa.array([flat], pa.list_(pa.int64()))})

    most = tables.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    if most <= fan:
        return tables.groupBy("conv_id").applyInArrow(whole, _ENDS)
    # `at` has gaps for no conversation that crosses blocks, so `fan` values of it are `fan` tables at most.
    grouped = tables.withColumn("up", F.floor(F.col("at") / fan))
    above = stage(grouped.groupBy("conv_id", "up").applyInArrow(join, "conv_id bigint, at bigint, flat array<bigint>"), "tables")
    ends = table_ends(above, fan).select(F.col("conv_id").alias("_conv"), F.col("at").alias("_up"), "before", "after", "last")
    return (grouped.join(ends, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("up") == F.col("_up")))
            .drop("_conv", "_up").groupBy("conv_id", "up").applyInArrow(within, _ENDS))


def row_solutions(faults: DataFrame, ends: DataFrame) -> DataFrame:
    """(position, edit, inserted, new_role, appended): the best edit of each row; ``inserted``
    are the roles of rows put before it, ``appended`` those after the last row."""
    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("position")
        kinds = bytes(block.column("kind").to_pylist())
        known = [block.column(c).to_pylist() for c in ("before", "after", "last")]
        edits, inserted, roles, appended, solved = [], [], [], [], {}  # conversations of a block repeat their patterns
        for a, b, _ in _segments(block):
            before, after, last = (c[a] for c in known)
            case = kinds[a:b], START if before is None else before, after
            if case not in solved:
                solved[case] = solve(*case)
            states = solved[case]
            for k, s, t in zip(case[0], (case[1], *states), states):
                _, letters, new, role = EDITS[k][s][t]
                edits.append(letters[-1])
                inserted.append([ROLE_OF[r] for r in new])
                roles.append(ROLE_OF.get(role))
                appended.append([])
            if last is not False:
                appended[-1] = [ROLE_OF[r] for r in LAST[states[-1]]]
        strings = pa.list_(pa.string())
        return pa.table({"position": block.column("position"), "edit": pa.array(edits, pa.string()), "inserted": pa.array(inserted, strings),
                         "new_role": pa.array(roles, pa.string()), "appended": pa.array(appended, strings)})

    states = ends.select(F.col("conv_id").alias("_conv"), F.col("at").alias("_at"), "before", "after", "last")
    here = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_at"))
    return (faults.select("conv_id", "position", "block", "kind").join(states, here, "left").drop("_conv", "_at").groupBy("block")
            .applyInArrow(run, "position bigint, edit string, inserted array<string>, new_role string, appended array<string>"))


def repair(rows: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """Every row with its ``fault`` and its ``edit`` (K, R, D), its cost with the rows put around it,
    the role it gets (``new_role``, null: its own) and the roles ``inserted`` before and ``appended`` after it."""
    placed = laid_out(rows, block)
    faults = stage(with_faults(placed), "faults")
    ends = table_ends(stage(block_tables(faults), "tables"), fan)
    solved = row_solutions(faults, ends)
    cost = (INSERT * (F.size("inserted") + F.size("appended"))
            + F.when(F.col("edit") == "D", DELETE).otherwise(F.when(F.col("edit") == "R", REROLE).otherwise(0)
                                                              + F.when(F.col("fault") == "truncated", TRUNCATED).otherwise(0)))
    return (placed.select("position", "role", "text").join(faults, "position").join(solved, "position")
            .withColumn("cost", cost.cast("bigint")))


def repaired(edits: DataFrame) -> DataFrame:
    """Rows of the repaired conversations: conv_id, position and number of the row at it, role, text."""
    own = F.struct(F.coalesce("new_role", "role").alias("role"), F.col("text").alias("text"))
    new = [F.transform(c, lambda r: F.struct(r.alias("role"), F.lit("").alias("text"))) for c in ("inserted", "appended")]
    kept = F.when(F.col("edit") != "D", F.array(own)).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    return edits.select("conv_id", "position", F.posexplode(F.concat(new[0], kept, new[1])).alias("number", "row")).select(
        "conv_id", "position", "number", "row.role", "row.text")


def _digests(chunks: DataFrame) -> DataFrame:
    """(conv_id, audit, illegal, repaired_sha256) of conversations whose chunks of at
    most a block each arrive in order; SHA-256 goes on from chunk to chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        legal = {"su", "ua", "au"}
        open_ = None

        def closed(state: list) -> pa.RecordBatch:
            conv, audit, illegal, _, sha, _ = state
            return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array(["".join(audit)]), pa.array([illegal], pa.int64()),
                                               pa.array([sha.hexdigest()])], ["conv_id", "audit", "illegal", "repaired_sha256"])

        for batch in batches:
            for conv, audit, initials, lines in zip(*[c.to_pylist() for c in batch.columns]):
                if open_ is None or open_[0] != conv:
                    if open_ is not None:
                        yield closed(open_)
                    open_ = [conv, [], 0, "", hashlib.sha256(), False]
                open_[1].append(audit)
                run_ = open_[3] + initials
                open_[2] += sum(run_[i:i + 2] not in legal for i in range(len(run_) - 1))
                open_[3] = initials[-1:]
                if lines is not None:
                    open_[4].update((("\n" if open_[5] else "") + lines).encode())
                    open_[5] = True
        if open_ is not None:
            yield closed(open_)

    return (chunks.repartition("conv_id").sortWithinPartitions("conv_id", "block").select("conv_id", "audit", "initials", "lines")
            .mapInArrow(run, "conv_id bigint, audit string, illegal bigint, repaired_sha256 string"))


def report(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """One row per ``conv_id`` of ``rows``: counts of faults, cost, audit and digest of its repair."""
    letters = F.concat(F.repeat(F.lit("I"), F.size("inserted")), F.col("edit"), F.repeat(F.lit("I"), F.size("appended")))
    own = F.when(F.col("edit") != "D", F.array(F.concat_ws(":", F.coalesce("new_role", "role"), "text"))).otherwise(F.array().cast("array<string>"))
    lines = F.concat(F.transform("inserted", lambda r: F.concat(r, F.lit(":"))), own, F.transform("appended", lambda r: F.concat(r, F.lit(":"))))
    inside = F.sort_array(F.collect_list(F.struct("position", letters.alias("letters"), "initial", lines.alias("lines"))))
    chunks = edits.groupBy("conv_id", "block").agg(inside.alias("_rows")).select(
        "conv_id", "block", F.array_join(F.col("_rows.letters"), "").alias("audit"), F.array_join(F.col("_rows.initial"), "").alias("initials"),
        F.flatten(F.col("_rows.lines")).alias("_lines")).select(
        "conv_id", "block", "audit", "initials", F.when(F.size("_lines") > 0, F.array_join("_lines", "\n")).alias("lines"))
    counts = edits.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")], F.sum("cost").alias("cost"))
    out = rows.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    for part in (counts, _digests(chunks)):
        out = out.join(part.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.fillna(0, numbers).fillna({"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}).select(
        "conv_id", *numbers, "audit", "repaired_sha256")


@register("op11_conversation_repair")
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by their key and repaired: faults, cost, audit and digest of each."""
    rows = read(spark, sf_dir, "conversations")
    return report(rows, stage(repair(damaged(rows)), "edits"))
