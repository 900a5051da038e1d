"""Queries of this subpackage against their SQL in DuckDB: on the given tables, and on odd rows."""

import random

import pyarrow as pa
import pytest

from webloom.llm import conversation_repair, fill_middle, queries, repeat_spans

duckdb = pytest.importorskip("duckdb")

SF = "/root/testdata/sf0.001"


def agree(found, want):
    columns = sorted(found.columns)
    assert sorted(want.columns) == columns
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in found.collect())
    assert rows == sorted(map(repr, want.select(*[f'"{c}"' for c in columns]).fetchall()))


@pytest.fixture
def connection():
    with duckdb.connect() as c:
        yield c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_given_tables(spark, connection, name):
    for t in ("documents", "benchmark", "conversations"):
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    agree(queries.queries()[name](spark, SF), connection.sql(queries.oracle_sql()[name]))


def odd_texts():
    rng = random.Random(4)
    long = "".join(rng.choice("abcde ") for _ in range(400))
    texts = [None, "", "short", long, long[100:300] + "!" + long[50:149], "é" * 60, "x" * 49, "x" * 50, "x" * 200, long[:50] + long[50:100], "<P>" + long]
    return [(i, t) for i, t in enumerate(texts)] + [(3, long), (20, "tail " + long[350:] + " end"), (21, "日本語" * 40), (22, "e" + "é" * 60)]


@pytest.mark.parametrize("name, run", [("op11_repeat_spans", repeat_spans.report), ("op12_fill_middle", fill_middle.report)])
def test_odd_texts(spark, connection, name, run):
    rows = odd_texts()
    documents = pa.table({"doc_id": pa.array([d for d, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())})
    connection.register("documents", documents)
    agree(run(spark.createDataFrame(rows, "doc_id long, text string")), connection.sql(queries.oracle_sql()[name]))


def test_odd_conversations(spark, connection):
    rng = random.Random(6)
    texts = ["Yes.", "No!", "Why", "", " ", "And so on, ", "Well?\n", "é.", "x" * 300 + ".", None]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    rows = []
    for conv in [*range(60), None]:
        for t in range(rng.randrange(1, 14)):
            rows.append((conv, None if rng.random() < 0.05 else t + rng.randrange(2), rng.choice(roles), rng.choice(texts) if rng.random() < 0.4 else f"say {t}."))
    rows += [(c, 0, "user", "One.") for c in range(300, 340)]  # some lose their only row
    kinds = {"conv_id": pa.int64(), "turn": pa.int64(), "role": pa.string(), "text": pa.string()}
    connection.register("conversations", pa.table({c: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate(kinds.items())}))
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = conversation_repair.report(conversation_repair.repair(conversation_repair.damage(data)))
    agree(found, connection.sql(queries.oracle_sql()["op13_conversation_repair"]))
