from pyspark.sql import functions as F

from webloom.llm import near_dup


def test_one_python_function_in_a_stage(spark, monkeypatch):
    """A task that runs two Python functions holds two workers, which keep their memory through all later stages."""
    plans, inner = [], near_dup.components

    def seen(edges):
        plans.append(edges._jdf.queryExecution().executedPlan().toString())
        return inner(edges)

    monkeypatch.setattr(near_dup, "components", seen)
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b c d e f g h i j k l m n o p q r s t u v w x y z "), (F.col("id") % 7).cast("string")).alias("text"))
    rows = near_dup.near_duplicates(docs).collect()
    assert {r["component_id"] for r in rows} == {0} and len(rows) == 40
    assert len(plans) == 2 and not any("MapInArrow" in p for p in plans)
