"""op13 against exhaustive search and a plain version, whole and cut in parts and blocks."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from webloom.llm import conversation_repair as repair
from webloom.llm import queries

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def allowed(initials):
    return re.fullmatch(r"(s?(ua)+)?", initials) is not None


def plain_edits(rows):
    """(cost, audit) of rows (initial, fault) by search over positions, edits and initials so far (only their last one matters, and whether there are any)."""

    known = {}

    def best(i, last, fresh):
        if (i, last, fresh) not in known:
            known[i, last, fresh] = try_all(i, last, fresh)
        return known[i, last, fresh]

    def try_all(i, last, fresh):
        options = []
        if i == len(rows) and (last in ("", "a")):
            options.append((0, ""))
        then = {"": "u", "s": "u", "u": "a", "a": "u"}[last]
        if fresh < 2:
            cost, edits = best(i, then, fresh + 1)
            options.append((cost + 3, "I" + edits))
        if i < len(rows):
            initial, fault = rows[i]
            cost, edits = best(i + 1, last, 0)
            options.append((cost + 4, "D" + edits))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                cost, edits = best(i + 1, then, 0)
                options.append((cost + 3 + more, "R" + edits))
                if initial == then or (initial == "s" and last == ""):
                    cost, edits = best(i + 1, initial, 0)
                    options.append((cost + more, "K" + edits))
        return min(options, default=(10**9, ""))

    for i in range(len(rows), -1, -1):  # from the end, so that calls stay shallow
        for last, fresh in itertools.product(("", "s", "u", "a"), (2, 1, 0)):
            best(i, last, fresh)
    return best(0, "", 0)


def exhaustive(rows):
    """The same by trying every string of edits with at most two inserts in a row."""
    found = []
    for gaps in itertools.product(range(3), repeat=len(rows) + 1):
        for edits in itertools.product("DKR", repeat=len(rows)):
            audit, out, cost = "", "", 0
            new = lambda: "a" if out.endswith("u") else "u"
            for k in range(len(rows) + 1):
                for _ in range(gaps[k]):
                    audit, out, cost = audit + "I", out + new(), cost + 3
                if k == len(rows):
                    break
                audit += edits[k]
                initial, fault = rows[k]
                if edits[k] == "D":
                    cost += 4
                    continue
                if fault in ("blank", "duplicate"):
                    cost = None
                    break
                out += initial if edits[k] == "K" else new()
                cost += 3 * (edits[k] == "R") + 3 * (fault == "truncated")
            if cost is not None and allowed(out):
                found.append((cost, audit))
    return min(found)


def plain_version(rows):
    """The contract's row for each conv_id of (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        after = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            one = lambda x: " " if x is None else x
            fate = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
            role, text = one(role), one(text)
            if fate == 0:
                continue
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            after += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in after:
            bare = text.strip(SPACE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {r[0] for r in after if r[0] is not None}
        initials = [r[1][:1] for r in after]
        cost, audit = plain_edits(tuple(zip(initials, faults)))
        left, repaired = iter(after), []
        for edit in audit:
            row = next(left) if edit != "I" else (None, None, "")
            last = repaired[-1][0][:1] if repaired else ""
            if edit == "K":
                repaired.append((row[1], row[2]))
            elif edit != "D":
                repaired.append(("assistant" if last == "u" else "user", row[2]))
        assert allowed("".join(r[0][:1] for r in repaired)) and next(left, None) is None
        text = "\n".join(f"{r}:{t}" for r, t in repaired)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        count = [faults.count(x) for x in ("blank", "duplicate", "truncated")]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (conv, gaps, *count, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


SYMBOLS = [(i, f) for i in "suax" for f in ("", "truncated")] + [("u", "blank")]


def test_edits_against_exhaustive_search():
    for n in range(4):
        for rows in itertools.product(SYMBOLS[:7:2] + [SYMBOLS[3], SYMBOLS[8]], repeat=n):
            assert plain_edits(rows) == exhaustive(rows)
    code = {"": 0, "blank": repair.BLANK, "duplicate": repair.DUPLICATE, "truncated": repair.CUT}
    rng = random.Random(5)
    for n in [*range(1, 5)] * 60 + [*range(5, 60)] * 4:
        rows = [rng.choice(SYMBOLS) for _ in range(n)]
        if rng.random() < 0.5:  # long runs
            rows = [r for r in rows[:6] for _ in range(rng.randrange(1, 1 + n))][:250]
        symbols = "".join(repair.symbol(i, code[f]) for i, f in rows)
        assert repair._whole(symbols) == plain_edits(tuple(rows)), rows
        # The same through blocks of any size.
        size = rng.randrange(1, len(rows) + 1)
        blocks = [symbols[k : k + size] for k in range(0, len(symbols), size)]
        after = [repair.END]
        for b in reversed(blocks):
            after.append(repair._before(repair.summary(b), after[-1]))
        after.reverse()
        state, audit = 0, ""
        for b, later in zip(blocks, after[1:]):
            expected = repair._exit(repair.summary(b), state, later)
            _, edits, state = repair.solve(repair.runs(b), state, later)
            assert state == expected
            audit += edits
        assert audit + repair.TAIL[state] == plain_edits(tuple(rows))[1]


def test_long_run():
    cost, audit, state = repair.solve([("u", 10**6)])
    assert len(audit) - audit.count("I") == 10**6 and cost + repair.END[state] == repair._whole("u" * 10**6)[0]


def rows_of(rng, n, conv):
    texts = ["Yes.", "No!", "Why", "", " ", "And so on, ", "Well?\n", "é.", "x" * 300 + ".", None]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    return [(conv, None if rng.random() < 0.05 else t + rng.randrange(2), rng.choice(roles), rng.choice(texts) if rng.random() < 0.4 else f"say {t}.") for t in range(n)]


@pytest.mark.parametrize("part_bytes, block_rows", [(repair.PART_BYTES, repair.BLOCK_ROWS), (3_000, 7), (400, 3)])
def test_odd_conversations(spark, part_bytes, block_rows):
    rng = random.Random(3)
    rows = [r for c in range(40) for r in rows_of(rng, rng.randrange(1, 12), c)] + rows_of(rng, 400, 100) + rows_of(rng, 30, None)
    rows += [(200, 1, "user", "Same.")] * 60 + [(201, None, "user", "Null turn.")] * 5 + [(202, t, "user", "Again.") for t in range(90)]
    rows += [(c, 0, "user", "One.") for c in range(300, 340)]  # some lose their only row
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("part", "place", "done", "block", "hash")})
    found = repair.report(repair.repair(repair.damage(data), part_bytes, block_rows)).collect()
    want = plain_version(rows)
    assert len(found) == len(want)
    for r in found:
        assert tuple(r) == want[r["conv_id"]]
    empty = repair.report(repair.repair(repair.damage(data.limit(0))))
    assert empty.count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = queries.op13_conversation_repair(spark, SF)
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r["conv_id"]: tuple(r) for r in found.collect()} == plain_version(rows)
