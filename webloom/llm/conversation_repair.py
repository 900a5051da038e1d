"""Conversations put right by the cheapest edits.

A conversation is right if the initials of its roles are an optional s and then
ua again and again. What an edit costs depends on a row's symbol (the initial of
its role and its fault) and on the state that the roles before have led to, so a
row is a min-plus matrix over four states. Equal symbols in a row are one run; a
run is passed through binary powers of its matrix, which are kept, and then its
choices are laid out again from the middles that the powers remember. Entries
carry a rank next to their cost: the order of their edits as strings. Edits of the
same rows never begin with one another, so ranks compose as costs do, and ties go
to the least string without any string being built.

At scale: rows are exchanged once, by ranges of (conv_id, turn, …), and sorted. A
conversation that begins and ends inside a part is done there. Those that touch
the ends of a part, which includes every one of more rows than a part, are cut in
blocks of at most `block_rows`: rows seen earlier are found by an aggregate of
fingerprints, each block becomes one matrix, one pass back and one forth over the
blocks' matrices give every block its states, and blocks are edited side by side.
No task holds more than a part, a block, or one row of 16 numbers at a time; only
the digest of a conversation reads its blocks in order, as a stream.

Rows are in the order of turn (nulls first), role, the first 64 characters of the
text and its hash; equal rows are neighbours, and the later ones are duplicates.
Null roles and texts count as one space. A role without characters has no initial
and cannot be kept as it is. Rows of a null conv_id are one conversation. An empty
table gives an empty one; further columns, of any name, are left out.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm import common

#: Bytes of text in a part of the sorted rows.
PART_BYTES = 64 << 20

#: Rows of a block, where a conversation is cut.
BLOCK_ROWS = 4_096

SPACES = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
_DELETE, _REROLE, _INSERT, _TRUNCATED = 4, 3, 3, 3

#: States: nothing yet, after s, after u, after a. Where an inserted or new role leads from each.
_START, _S, _U, _A = range(4)
_NEXT = (_U, _U, _A, _U)
_KEPT = {"s": {_START: _S}, "u": {_START: _U, _S: _U, _A: _U}, "a": {_U: _A}, "x": {}}

#: What is left to do at the end, from each state.
END, TAIL = (0, 2 * _INSERT, _INSERT, 0), ("", 2 * INSERT, INSERT, "")

_FAR = 1 << 60
BLANK, DUPLICATE, CUT = 1, 2, 3


def symbol(initial: str, fault: int) -> str:
    """d for what must go, else the initial (x for others), in upper case if the row is truncated."""
    if fault in (BLANK, DUPLICATE):
        return "d"
    known = initial if initial in ("s", "u", "a") else "x"
    return known.upper() if fault == CUT else known


class _Matrix:
    """Least costs between states, the rank of their edits among those from one state, and the state half way."""

    __slots__ = ("cost", "rank", "middle")

    def __init__(self, cost, rank, middle=None):
        self.cost, self.rank, self.middle = cost, rank, middle


def _ranked(keys: list) -> list[int]:
    order = sorted((k, j) for j, k in enumerate(keys) if k is not None)
    rank = [0] * 4
    for place, (_, j) in enumerate(order):
        rank[j] = place
    return rank


@functools.cache
def _row(of: str) -> tuple[_Matrix, dict]:
    """The matrix of one row, inserts before it included, and its edits by (from, to)."""
    more = _TRUNCATED if of.isupper() else 0
    cost, edits = [[_FAR] * 4 for _ in range(4)], {}
    for i in range(4):
        state = i
        for inserts in range(3):
            options = [(_DELETE, DELETE, state)]
            if of != "d":
                options.append((_REROLE + more, REROLE, _NEXT[state]))
                if state in _KEPT[of.lower()]:
                    options.append((more, KEEP, _KEPT[of.lower()][state]))
            for price, edit, j in options:
                found = (price + inserts * _INSERT, INSERT * inserts + edit)
                if found < (cost[i][j], edits.get((i, j), "~")):
                    cost[i][j], edits[i, j] = found
            state = _NEXT[state]
    return _Matrix(cost, [_ranked([edits.get((i, j)) for j in range(4)]) for i in range(4)]), edits


def _composed(a: _Matrix, b: _Matrix) -> _Matrix:
    cost, rank, middle = [], [], []
    for i in range(4):
        best = []
        for j in range(4):
            best.append(min((a.cost[i][k] + b.cost[k][j], a.rank[i][k], b.rank[k][j], k) for k in range(4)))
        cost.append([min(x[0], _FAR) for x in best])
        rank.append(_ranked([x[1:3] if x[0] < _FAR else None for x in best]))
        middle.append([x[3] for x in best])
    return _Matrix(cost, rank, middle)


@functools.cache
def _power(of: str, k: int) -> _Matrix:
    """The matrix of 2**k equal rows."""
    return _row(of)[0] if k == 0 else _composed(_power(of, k - 1), _power(of, k - 1))


@functools.lru_cache(4096)
def _laid_out(of: str, k: int, i: int, j: int) -> str:
    """The edits of 2**k equal rows between two states."""
    if k == 0:
        return _row(of)[1][i, j]
    middle = _power(of, k).middle[i][j]
    return _laid_out(of, k - 1, i, middle) + _laid_out(of, k - 1, middle, j)


def runs(symbols: Iterable[str]) -> list[tuple[str, int]]:
    found: list[list] = []
    for s in symbols:
        if found and found[-1][0] == s:
            found[-1][1] += 1
        else:
            found.append([s, 1])
    return [(s, n) for s, n in found]


def _steps(of_runs: Iterable[tuple[str, int]]) -> list[tuple[str, int]]:
    """(symbol, k) of the binary powers that make up the runs."""
    return [(s, k) for s, n in of_runs for k in range(n.bit_length()) if n >> k & 1]


def _before(matrix: _Matrix, after: tuple) -> tuple:
    return tuple(min(c + f for c, f in zip(row, after)) for row in matrix.cost)


def _exit(matrix: _Matrix, state: int, after: tuple) -> int:
    return min((c + f, r, j) for j, (c, f, r) in enumerate(zip(matrix.cost[state], after, matrix.rank[state])))[2]


def solve(of_runs: Iterable[tuple[str, int]], state: int = _START, after: tuple = END) -> tuple[int, str, int]:
    """(cost, edits, last state) of the cheapest edits of the rows, where `after` is the cost of what follows from each state."""
    steps = _steps(of_runs)
    ahead = [after]
    for of, k in reversed(steps):
        ahead.append(_before(_power(of, k), ahead[-1]))
    ahead.reverse()
    cost, edits = 0, []
    for (of, k), later in zip(steps, ahead[1:]):
        matrix = _power(of, k)
        j = _exit(matrix, state, later)
        cost += matrix.cost[state][j]
        edits.append(_laid_out(of, k, state, j))
        state = j
    return cost, "".join(edits), state


@functools.lru_cache(100_000)
def _whole(symbols: str) -> tuple[int, str]:
    cost, edits, state = solve(runs(symbols))
    return cost + END[state], edits + TAIL[state]


def summary(symbols: Iterable[str]) -> _Matrix | None:
    """One matrix for all rows; None without rows."""
    steps = [_power(of, k) for of, k in _steps(runs(symbols))]
    return functools.reduce(_composed, steps) if steps else None


def edited(rows: Iterable[tuple[str, str]], edits: str, state: int = _START) -> list[dict]:
    """The rows (role, text) after the edits."""
    left, done = iter(rows), []
    for edit in edits:
        if edit == DELETE:
            next(left)
        elif edit == KEEP:
            role, text = next(left)
            state = _KEPT[role[:1]][state]
            done.append({"role": role, "text": text})
        else:
            text = next(left)[1] if edit == REROLE else ""
            done.append({"role": "assistant" if state == _U else "user", "text": text})
            state = _NEXT[state]
    return done


_LEGAL = {"su", "ua", "au"}

_COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")
_TURNS = ("min_turn", "max_turn", "distinct_turns", "first_turn", "last_turn")
_DONE = pa.struct(
    [(c, pa.int64()) for c in (*_COUNTS, *_TURNS)]
    + [("first_initial", pa.string()), ("last_initial", pa.string()), ("audit", pa.string()), ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))]
)
_DONE_SQL = "struct<" + ", ".join(
    [f"{c}: long" for c in (*_COUNTS, *_TURNS)] + ["first_initial: string", "last_initial: string", "audit: string", "turns: array<struct<role: string, text: string>>"]
) + ">"


def _counted(rows: list[tuple[int | None, str, int]]) -> dict:
    """Counts over rows (turn, initial, fault) of a block that are in order."""
    initials, faults = [r[1] for r in rows], [r[2] for r in rows]
    turns = [r[0] for r in rows if r[0] is not None]
    return {
        "blank": faults.count(BLANK),
        "duplicate": faults.count(DUPLICATE),
        "truncated": faults.count(CUT),
        "illegal": sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:])),
        "min_turn": turns[0] if turns else None,
        "max_turn": turns[-1] if turns else None,
        "distinct_turns": len(set(turns)),
        "first_turn": turns[0] if turns else None,
        "last_turn": turns[-1] if turns else None,
        "first_initial": initials[0] if rows else None,
        "last_initial": initials[-1] if rows else None,
    }


def _fault(text: str) -> int:
    """BLANK, CUT or 0 by the text alone."""
    bare = text.rstrip(SPACES)
    return BLANK if not bare else CUT if bare[-1] not in ".!?" else 0


def _done(rows: list[tuple[int | None, str, str]]) -> dict:
    """All about a conversation whose rows (turn, role, text) are here, in order."""
    seen, marked = set(), []
    for turn, role, text in rows:
        fault = _fault(text)
        if fault != BLANK and (role, text) in seen:
            fault = DUPLICATE
        seen.add((role, text))
        marked.append((turn, role[:1], fault))
    cost, edits = _whole("".join(symbol(i, f) for _, i, f in marked)) if marked else (0, "")
    return _counted(marked) | {"cost": cost, "audit": edits, "turns": edited(((r, t) for _, r, t in rows), edits)}


def _ordered(rows: DataFrame, part_bytes: int) -> DataFrame:
    """(conv_id, turn, role, text, gone) in parts of the order, sorted."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"), F.coalesce(gone, F.lit(False)).alias("gone"))
    size = plain.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("conv_id"), F.col("turn"), F.col("role"), F.substring("text", 1, 64).alias("head"), F.sha2("text", 256).alias("hash"), F.monotonically_increasing_id().alias("nth")]
    keyed = plain.select(*order, "text", "gone")
    names = ["conv_id", "turn", "role", "head", "hash", "nth"]  # the last one splits rows that are equal
    return keyed.repartitionByRange(max(least, size // part_bytes + 1), *names).sortWithinPartitions(*names).select("conv_id", "turn", "role", "text", "gone")


def _first_pass(sorted_rows: DataFrame) -> DataFrame:
    """(conv_id, part, place, turn, role, text, gone, fault, print, done): `done` of conversations that lie inside a part, the rows of others."""
    kind = sorted_rows.schema["conv_id"].dataType.simpleString()
    columns = f"conv_id {kind}, part int, place long, turn long, role string, text string, gone boolean, fault int, print binary, done {_DONE_SQL}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids, out, size, place = None, [], 0, 0
        now, first, held = None, True, []  # now: [conv_id] once a row was read

        def opened(conv, row):
            nonlocal place
            turn, role, text, gone = row
            place += 1
            mark = hashlib.sha256(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")).digest()
            return (conv, place - 1, turn, role, text, gone, _fault(text), mark, None)

        def batch_of():
            names = ("conv_id", "place", "turn", "role", "text", "gone", "fault", "print", "done")
            kinds = (ids, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.binary(), _DONE)
            made = {n: pa.array([r[i] for r in out], k) for i, (n, k) in enumerate(zip(names, kinds))}
            made["part"] = pa.array([part] * len(out), pa.int32())
            order = ("conv_id", "part", *names[1:])
            return pa.RecordBatch.from_arrays([made[n] for n in order], names=list(order))

        for batch in batches:
            ids = batch.schema.field("conv_id").type
            for conv, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or conv != now[0]:
                    if now is not None and not first:
                        out.append((now[0], 0, None, None, None, False, 0, None, _done([r[:3] for r in held if not r[3]])))
                    first, now, held = now is None, [conv], []
                if first:
                    out.append(opened(conv, row))
                else:
                    held.append(row)
                size += len(row[2])
                if size > 4_000_000 or len(out) >= 4_000:
                    yield batch_of()
                    out, size = [], 0
        if now is not None and not first:
            for row in held:
                out.append(opened(now[0], row))
                if len(out) >= 4_000:
                    yield batch_of()
                    out = []
        if out:
            yield batch_of()

    return sorted_rows.mapInArrow(run, columns)


def _flat(matrix: _Matrix | None) -> tuple[list[int], list[int]]:
    if matrix is None:
        return [0 if i == j else _FAR for i in range(4) for j in range(4)], [0] * 16
    return [c for row in matrix.cost for c in row], [r for row in matrix.rank for r in row]


def _of_flat(cost: list[int], rank: list[int]) -> _Matrix:
    return _Matrix([cost[4 * i : 4 * i + 4] for i in range(4)], [rank[4 * i : 4 * i + 4] for i in range(4)])


_BLOCK = ["conv_id", "part", "block"]


def _summaries(opened: DataFrame) -> DataFrame:
    """(conv_id, part, block, symbols, cost, rank, counts): one row for each block of rows without their texts."""
    kind = opened.schema["conv_id"].dataType.simpleString()
    alive = opened.where("not gone")
    firsts = alive.groupBy("conv_id", "print").agg(F.min(F.struct("part", "place")).alias("f")).select("f.part", "f.place", F.lit(True).alias("first"))
    skinny = opened.select(*_BLOCK, "place", "turn", F.substring("role", 1, 1).alias("initial"), "gone", "fault").join(firsts, ["part", "place"], "left")
    fault = F.when((F.col("fault") != BLANK) & F.col("first").isNull(), DUPLICATE).otherwise(F.col("fault"))
    skinny = skinny.select(*_BLOCK, "place", "turn", "initial", "gone", fault.alias("fault"))

    def run(table: pa.Table) -> pa.Table:
        rows = [r for r in table.sort_by("place").select(["turn", "initial", "fault", "gone"]).to_pylist() if not r["gone"]]
        marked = [(r["turn"], r["initial"], r["fault"]) for r in rows]
        symbols = "".join(symbol(i, f) for _, i, f in marked)
        cost, rank = _flat(summary(symbols))
        counts = _counted(marked) | {"cost": 0, "audit": "", "turns": []}
        keys = [table.column(c).slice(0, 1).combine_chunks() for c in _BLOCK]
        made = [pa.array([symbols]), pa.array([cost], pa.list_(pa.int64())), pa.array([rank], pa.list_(pa.int64())), pa.array([counts], _DONE)]
        return pa.table([*keys, *made], names=[*_BLOCK, "symbols", "cost", "rank", "counts"])

    return skinny.groupBy(*_BLOCK).applyInArrow(run, f"conv_id {kind}, part int, block long, symbols string, cost array<long>, rank array<long>, counts {_DONE_SQL}")


def _streamed(rows: DataFrame, order: list, schema: str, step) -> DataFrame:
    """`rows` of each conversation as a stream in an order; step(row, state or None) -> (row, state)."""
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if now is None or now[0] != row["conv_id"]:
                    now, state = [row["conv_id"]], None
                made, state = step(row, state)
                found.append(made)
            if found:
                kinds = {f.name: f.type for f in batch.schema}
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], kinds.get(n, _NEW.get(n))) for n in found[0]], names=list(found[0]))

    return dealt.mapInArrow(run, schema)


_NEW = {"after": pa.list_(pa.int64()), "last": pa.bool_(), "state": pa.int32()}


def _with_states(blocks: DataFrame) -> DataFrame:
    """(conv_id, part, block, after, last, state): what each block begins with, and what follows it."""
    kind = blocks.schema["conv_id"].dataType.simpleString()
    sent = ["conv_id", "part", "block", "cost", "rank"]

    def back(row, after):
        last = after is None
        after = list(END) if last else after
        before = _before(_of_flat(row["cost"], row["rank"]), tuple(after))
        return row | {"after": after, "last": last}, list(before)

    def forth(row, state):
        state = _START if state is None else state
        made = {k: row[k] for k in _BLOCK} | {"after": row["after"], "last": row["last"], "state": state}
        return made, _exit(_of_flat(row["cost"], row["rank"]), state, tuple(row["after"]))

    schema = f"conv_id {kind}, part int, block long, cost array<long>, rank array<long>, after array<long>, last boolean"
    known = _streamed(blocks.select(*sent), [F.desc("part"), F.desc("block")], schema, back)
    return _streamed(known, ["part", "block"], f"conv_id {kind}, part int, block long, after array<long>, last boolean, state int", forth)


def _edited_blocks(opened: DataFrame, blocks: DataFrame) -> DataFrame:
    """(conv_id, part, block, done) of every block, edited beside the others."""
    kind = opened.schema["conv_id"].dataType.simpleString()
    same = [F.col(f"b.{c}").eqNullSafe(F.col(f"s.{c}")) for c in _BLOCK]
    told = blocks.alias("b").join(_with_states(blocks).alias("s"), same).select(*(f"b.{c}" for c in _BLOCK), "symbols", "counts", "after", "last", "state")
    texts = opened.select(*_BLOCK, "place", "role", "text", "gone")

    def run(rows: pa.Table, block: pa.Table) -> pa.Table:
        (told,) = block.to_pylist()
        cost, edits, state = solve(runs(told["symbols"]), told["state"], tuple(told["after"]))
        if told["last"]:
            cost, edits = cost + END[state], edits + TAIL[state]
        alive = [(r["role"], r["text"]) for r in rows.sort_by("place").select(["role", "text", "gone"]).to_pylist() if not r["gone"]]
        done = told["counts"] | {"cost": cost, "audit": edits, "turns": edited(alive, edits, told["state"])}
        keys = [block.column(c).combine_chunks() for c in _BLOCK]
        return pa.table([*keys, pa.array([done], _DONE)], names=[*_BLOCK, "done"])

    return texts.groupBy(*_BLOCK).cogroup(told.groupBy(*_BLOCK)).applyInArrow(run, f"conv_id {kind}, part int, block long, done {_DONE_SQL}")


def repair(rows: DataFrame, part_bytes: int = PART_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(conv_id, whole, part, block, done) of conversations given as rows (conv_id, turn, role, text, optional gone).

    `done` holds the repaired turns, the audit (one letter for each edit) and the
    counts of a block, by (part, block); `whole` says that a conversation is in one.
    Rows that are `gone` only say that their conversation exists.
    """
    passed = common.stage(_first_pass(_ordered(rows, part_bytes)), "conversations")
    whole = passed.where("done is not null").select("conv_id", F.lit(True).alias("whole"), "part", F.lit(0).cast("long").alias("block"), "done")
    opened = passed.where("done is null").withColumn("block", F.floor(F.col("place") / block_rows))
    blocks = common.stage(_summaries(opened), "blocks")
    cut = _edited_blocks(opened, blocks).select("conv_id", F.lit(False).alias("whole"), "part", "block", "done")
    return whole.unionByName(cut)


_REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _digest(cut: DataFrame) -> DataFrame:
    """The report on conversations in several blocks, which are read in order, one at a time."""
    kind = cut.schema["conv_id"].dataType.simpleString()
    dealt = cut.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block").select("conv_id", "done")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, ids = None, {}, None

        def report() -> pa.RecordBatch:
            gaps = total["max"] - total["min"] + 1 - total["turns"] if total["turns"] else 0
            values = [now[0], gaps, *(total[c] for c in _COUNTS), "".join(total["audit"]), total["hash"].hexdigest()]
            kinds = [ids, *[pa.int64()] * len(_REPORT), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["conv_id", *_REPORT, "audit", "repaired_sha256"])

        for batch in batches:
            ids = batch.schema.field("conv_id").type
            for i in range(batch.num_rows):
                conv, done = batch.column("conv_id")[i].as_py(), batch.column("done")[i].as_py()
                if now is None or now[0] != conv:
                    if now is not None:
                        yield report()
                    now = [conv]
                    total = dict.fromkeys(_COUNTS, 0) | {"hash": hashlib.sha256(), "audit": [], "any": False, "initial": None, "turns": 0, "min": None, "max": None}
                for c in _COUNTS:
                    total[c] += done[c]
                if done["first_initial"] is not None:
                    total["illegal"] += total["initial"] is not None and total["initial"] + done["first_initial"] not in _LEGAL
                    total["initial"] = done["last_initial"]
                if done["distinct_turns"]:
                    total["turns"] += done["distinct_turns"] - (total["max"] == done["first_turn"])
                    total["min"] = done["min_turn"] if total["min"] is None else total["min"]
                    total["max"] = done["max_turn"]
                total["audit"].append(done["audit"])
                for turn in done["turns"]:
                    total["hash"].update(("\n" * total["any"] + f"{turn['role']}:{turn['text']}").encode("utf-8", "surrogatepass"))
                    total["any"] = True
        if now is not None:
            yield report()

    return dealt.mapInArrow(run, f"conv_id {kind}, {', '.join(f'{c} long' for c in _REPORT)}, audit string, repaired_sha256 string")


def report(repaired: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of what `repair` gives."""
    lines = F.transform("done.turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    gaps = F.coalesce(F.col("done.max_turn") - F.col("done.min_turn") + 1 - F.col("done.distinct_turns"), F.lit(0).cast("long"))
    whole = repaired.where("whole").select(
        "conv_id", gaps.alias("gaps"), *(f"done.{c}" for c in (*_COUNTS, "audit")), F.sha2(F.array_join(lines, "\n").cast("binary"), 256).alias("repaired_sha256")
    )
    return whole.unionByName(_digest(repaired.where("not whole")))


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): rows damaged by a hash of conv_id and turn; nulls in it, in role and in text count as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(fate.isin(0, 1), "").when(fate == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(fate == 4, "user").otherwise(space("role"))
    times = F.explode(F.sequence(F.lit(1), F.when(fate == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (fate == 0).alias("gone"), times.alias("nth")).drop("nth")
