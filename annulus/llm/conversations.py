"""Repair of the structure of conversations at the least cost.

The roles of a repaired conversation read ``(s?(ua)+)?`` by their initials. Edits keep a turn
(0), give it the role user or assistant (1), delete it (2) or insert an empty turn of user or
assistant (5); a truncated turn that stays adds 5, and blank or repeated turns have to go.
Of the cheapest edits those whose initials (D, I, K, R) come first in ASCII are taken.

Turns are cut into segments of ``SEGMENT_TURNS`` and dealt out by a hash of (conversation,
segment). In each batch of segments a recursive query of DuckDB advances one turn of all of
them at a time, and keeps the least (cost, edits) for each pair of grammar states that a segment
may begin and end in; so a conversation of any length is searched by many tasks. What its
segments found is folded in order, a few rows a segment. Equal costs never come with edits of
which one is a prefix of the other, as each but an insertion takes up one turn; so the least
edits of a part stay the least whatever follows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annulus.llm.ranks import ranked, same
from annulus.llm.storage import Store

SPACES = " \t\n\x0b\x0c\r"
SEGMENT_TURNS = 256
#: Turns that a query of a task holds at a time, unless one segment has more.
BATCH_TURNS = 8192
#: Steps that are passed on at a time.
STEP_ROWS = 1 << 16
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

#: Grammar states: nothing yet, after s, after u, after a. In which of them u and a may follow, and the state then.
_AFTER = {"s": ({0}, 1), "u": ({0, 1, 3}, 2), "a": ({2}, 3)}
_FINAL = (0, 3)
_CLASSES = "sua"
_WHOLE, _CUT, _GONE = range(3)


def _insertions(state: int) -> dict[int, str]:
    """States that insertions lead to, and the least of them."""
    found, at = {state: ""}, state
    for edits in ("I", "II"):
        at = 3 if at == 2 else 2
        found.setdefault(at, edits)
    return found


def _moves() -> list[tuple[int, int, int, int, str]]:
    """(state, kind of turn, next state, cost, edits), the least for each; kind: 3 * class of the role + state of the turn."""
    best: dict[tuple[int, int, int], tuple[int, str]] = {}
    for state in range(4):
        for between, inserted in _insertions(state).items():
            for kind in range(12):
                role, fault = kind // 3, kind % 3
                options = [(between, DELETE, "D")]
                for name, (of, to) in _AFTER.items():
                    if fault != _GONE and between in of:
                        stays = TRUNCATED * (fault == _CUT)
                        options += [(to, stays, "K")] * (_CLASSES.find(name) == role) + [(to, stays + REROLE, "R")] * (name != "s")
                for to, cost, edit in options:
                    one = (cost + INSERT * len(inserted), inserted + edit)
                    best[state, kind, to] = min(best.get((state, kind, to), one), one)
    return [(*key, *value) for key, value in best.items()]


_WALK = """
WITH RECURSIVE walk AS (
  SELECT DISTINCT segment, 0::BIGINT AS place, entry, entry AS state, {'cost': 0::BIGINT, 'edits': ''} AS best
  FROM turns, (VALUES (0), (1), (2), (3)) AS states(entry) WHERE entry = 0 OR NOT opening
  UNION ALL
  SELECT walk.segment, walk.place + 1, walk.entry, moves.next, min({'cost': walk.best.cost + moves.cost, 'edits': walk.best.edits || moves.edits})
  FROM walk
  JOIN turns ON turns.segment = walk.segment AND turns.place = walk.place
  JOIN moves ON moves.state = walk.state AND moves.kind = turns.kind
  GROUP BY walk.segment, walk.place, walk.entry, moves.next
), sizes AS (SELECT segment, count(*) AS turns FROM turns GROUP BY segment)
SELECT walk.segment, walk.entry, walk.state, walk.best.cost AS cost, walk.best.edits AS edits
FROM walk JOIN sizes ON sizes.segment = walk.segment AND sizes.turns = walk.place
ORDER BY walk.segment
"""
_WALKED = "conv_id long, segment long, entry long, state long, cost long, edits string, illegal long, first string, last string"


def _connection():
    import duckdb

    con = duckdb.connect(config={"threads": 1})
    columns = zip(*_moves())
    con.register("given", pa.table(dict(zip(("state", "kind", "next", "cost", "edits"), map(list, columns)))))
    con.execute("CREATE TABLE moves AS SELECT * FROM given")
    return con


def _walk_batch(con, batch: pa.RecordBatch) -> pa.RecordBatch:
    """Of whole segments in order: the least edits between states, and what the query of adjacent roles needs."""
    conv, segment = (batch.column(c) for c in ("conv_id", "segment"))
    ids, cut = conv.fill_null(0).to_numpy(), segment.to_numpy()
    missing = conv.is_null().to_numpy(zero_copy_only=False)
    new = np.ones(len(cut), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (missing[1:] != missing[:-1]) | (cut[1:] != cut[:-1])
    begin = np.flatnonzero(new)
    number = np.cumsum(new) - 1
    place = np.arange(len(cut)) - begin[number]
    kind = batch.column("kind").to_numpy()
    initial = np.array(batch.column("initial").to_pylist(), dtype=object)
    pair = np.array([a + b not in ("su", "ua", "au") for a, b in zip(initial[:-1], initial[1:])], dtype=bool)
    illegal = np.add.reduceat(np.append(False, pair & ~new[1:]).astype(np.int64), begin)
    con.register("given", pa.table({"segment": number, "place": place, "kind": kind, "opening": cut == 0}))
    con.execute("CREATE OR REPLACE TABLE turns AS SELECT * FROM given")
    found = con.sql(_WALK).to_arrow_table()
    at = found.column("segment").to_numpy()
    end = np.append(begin[1:], len(cut)) - 1
    out = pa.table(
        {
            "conv_id": conv.take(pa.array(begin[at])),
            "segment": cut[begin][at],
            **{c: found.column(c).cast(pa.int64()) for c in ("entry", "state", "cost")},
            "edits": found.column("edits").cast(pa.string()),
            "illegal": illegal[at],
            "first": pa.array(initial[begin][at], pa.string()),
            "last": pa.array(initial[end][at], pa.string()),
        }
    )
    return out.combine_chunks().to_batches()[0]


def _walked(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    con, held = _connection(), []

    def whole(rows: pa.Table, last: bool) -> tuple[pa.Table, pa.Table]:
        """The rows whose segments have ended, and the rest."""
        if last or not rows.num_rows:
            return rows, rows.slice(rows.num_rows)
        conv, segment = rows.column("conv_id").to_pylist(), rows.column("segment").to_pylist()
        at = rows.num_rows
        while at and (conv[at - 1], segment[at - 1]) == (conv[-1], segment[-1]):
            at -= 1
        return rows.slice(0, at), rows.slice(at)

    def of(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if rows.num_rows:
            yield _walk_batch(con, rows.combine_chunks().to_batches()[0])

    for batch in batches:
        for lo in range(0, batch.num_rows, most):
            held.append(batch.slice(lo, most))
            if sum(b.num_rows for b in held) >= most:
                ended, rest = whole(pa.Table.from_batches(held), False)
                yield from of(ended)
                held = rest.to_batches()
    if held:
        yield from of(pa.Table.from_batches(held))


_FOLDED = "conv_id long, illegal long, cost long, audit string"


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of conversations, in order, put one behind the other."""
    schema = pa.schema([("conv_id", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])
    conv, segment, begun, states, after, illegal, role = None, None, False, {}, {}, 0, None
    out: list[tuple] = []

    def close() -> None:
        ends = []
        for state, (cost, edits) in after.items():
            ends += [(cost + INSERT * len(more), edits + more) for to, more in _insertions(state).items() if to in _FINAL]
        out.append((conv, illegal, *min(ends)))

    for batch in batches:
        for c, s, entry, state, cost, edits, wrong, first, last in zip(*(x.to_pylist() for x in batch.columns)):
            if not begun or c != conv:
                if begun:
                    close()
                conv, segment, begun, after, illegal, role = c, None, True, {0: (0, "")}, 0, None
            if s != segment:
                segment, states, after = s, after, {}
                illegal += wrong + (role is not None and role + first not in ("su", "ua", "au"))
                role = last
            if entry in states:
                one = (states[entry][0] + cost, states[entry][1] + edits)
                after[state] = min(after.get(state, one), one)
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in out], schema=schema)
            out.clear()
    if begun:
        close()
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in out], schema=schema)


_STEPS = "conv_id long, place long, at long, edit string, role string"


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (conv_id, audit), for each turn that stays or comes: the row it is made of (none: inserted), its new place, and the role it is given."""
    for batch in batches:
        convs = batch.column("conv_id")
        for i, audit in enumerate(batch.column("audit").to_pylist()):
            edits = np.frombuffer(audit.encode(), np.uint8)
            stays = edits != ord("D")
            taken = edits != ord("I")
            source, at = np.cumsum(taken) - 1, np.cumsum(stays) - 1
            odd = int(stays.sum()) % 2  # an odd number begins with the system's turn
            for lo in range(0, len(edits), STEP_ROWS):
                keep = lo + np.flatnonzero(stays[lo : lo + STEP_ROWS])
                if not len(keep):
                    continue
                given = np.where((at[keep] - odd) % 2 == 0, "user", "assistant").astype(object)
                given[edits[keep] == ord("K")] = None
                yield pa.RecordBatch.from_arrays(
                    [
                        convs.take(pa.array(np.full(len(keep), i))),
                        pa.array(source[keep], pa.int64(), mask=~taken[keep]),
                        pa.array(at[keep], pa.int64()),
                        pa.array([chr(e) for e in edits[keep]], pa.string()),
                        pa.array(given, pa.string()),
                    ],
                    names=["conv_id", "place", "at", "edit", "role"],
                )


class Repaired(NamedTuple):
    """audits: a row for each conv_id with gaps, blank, duplicate, truncated, illegal, cost and audit; turns: the repaired turns (conv_id, place, role, text, edit)."""

    audits: DataFrame
    turns: DataFrame


def damage(convs: DataFrame) -> DataFrame:
    """The rows of convs with faults, by crc32 of ``conv_id:turn`` modulo 20 (nulls are one space).

    0 drops a row, 1 empties its text, 2 takes its full stops, exclamation and question marks,
    3 repeats it, 4 gives it the role user.
    """
    texts = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat(texts["conv_id"], F.lit(":"), texts["turn"]).cast("binary")) % 20
    rows = convs.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), texts["role"].alias("role"), texts["text"].alias("text"), kind.alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times)).drop("col")


def repair_conversations(convs: DataFrame, store: Store | None = None, segment_turns: int = SEGMENT_TURNS, batch_turns: int = BATCH_TURNS) -> Repaired:
    """Bring conversations into the grammar at the least cost.

    convs: conv_id long, turn long, role string and text string; other columns are ignored.
    A conversation's turns stand by turn (nulls first), those of one turn by role, then by a
    digest of the text. A null role or text counts as one space, a null conv_id is a
    conversation of its own. Of a turn's faults the first counts: blank (white space alone),
    duplicate (role and text stood earlier in the conversation), truncated (the last character
    that is not white space is none of ``.!?``). gaps: numbers missing between the least and the
    greatest turn. illegal: adjacent turns whose roles' initials are not su, ua or au. An
    empty table gives none. Repeated rows are duplicates of one another.
    """
    store = store or Store(convs.sparkSession, "conversations")
    rows = convs.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")),
    )
    rows = rows.withColumn("digest", F.sha2(F.concat_ws(":", F.octet_length("role"), "role", "text"), 256))
    rows = store.keep(ranked(rows, "conv_id", ["turn", "role", "digest"], store, "placed").withColumnRenamed("rank", "place"), "rows")
    firsts = rows.groupBy("conv_id", "digest").agg(F.min("place").alias("_first"))
    end = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    faulty = rows.select("conv_id", "turn", "place", "digest", F.left("role", F.lit(1)).alias("initial"), end.alias("_end"))
    fault = F.when(F.col("_end") == "", "blank").when(F.col("place") > F.col("_first"), "duplicate").when(~F.col("_end").isin(".", "!", "?"), "truncated")
    faulty = faulty.join(firsts, same(faulty, firsts, "conv_id", "digest")).select(faulty["conv_id"], "turn", "place", "initial", fault.alias("fault"))
    # what stands for a turn from here on is a few bytes, its text is fetched at the end
    faulty = store.keep(faulty, "faults")

    counts = faulty.groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"),
        *(F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")),
    )
    state = F.when(F.col("fault").isNull(), _WHOLE).when(F.col("fault") == "truncated", _CUT).otherwise(_GONE)
    role = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    turns = faulty.select("conv_id", F.expr(f"place div {int(segment_turns)}").alias("segment"), "place", (3 * role + state).cast("int").alias("kind"), "initial")
    walks = turns.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "place").drop("place").mapInArrow(lambda batches: _walked(batches, batch_turns), _WALKED)
    folded = store.keep(walks.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(_folded, _FOLDED), "audits")

    audits = folded.join(counts, same(folded, counts, "conv_id")).select(
        folded["conv_id"], F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit"
    )
    steps = folded.select("conv_id", "audit").where("audit <> ''").mapInArrow(_steps, _STEPS)
    of = rows.select("conv_id", "place", F.col("role").alias("_role"), F.col("text").alias("_text"))
    repaired = steps.join(of, same(steps, of, "conv_id") & (steps["place"] == of["place"]), "left")
    repaired = repaired.select(
        steps["conv_id"], F.col("at").alias("place"), F.coalesce("role", "_role").alias("role"), F.coalesce("_text", F.lit("")).alias("text"), "edit"
    )
    return Repaired(audits, repaired)
