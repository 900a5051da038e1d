"""Colours when vertices of many neighbours go first."""

import numpy as np

from webloom.operators import coloring


def test_hubs_first(spark, monkeypatch):
    """Two sides of unlike degrees take two rounds; given colours stay, and every colour is the least that is free."""
    staged = []
    stage = coloring.stage
    monkeypatch.setattr(coloring, "stage", lambda df, name: staged.append(name) or stage(df, name))
    rng = np.random.default_rng(1)
    pairs = sorted({(f"s{i}", f"p{int(p)}") for i in range(8) for p in rng.integers(0, 80, 60)})
    near = {v: {b for p in pairs if v in p for b in p} - {v} for v in {v for p in pairs for v in p}}
    ids = [f"s{i}" for i in range(8)] + [f"p{i}" for i in range(80)] + ["alone"]
    vertices = spark.createDataFrame([(i, 7 if i == "p3" else None) for i in ids], "id string, pre_color int")
    edges = spark.createDataFrame([*pairs, pairs[0], ("s1", "s1")], "src string, dst string")
    colors = dict(coloring.color(vertices, edges, hubs_first=True).collect())
    assert colors.keys() == set(ids) and colors["p3"] == 7 and colors["alone"] == 1
    assert all(colors[a] != colors[b] for a, b in pairs)
    assert all(set(range(1, colors[v])) <= {colors[u] for u in near.get(v, ())} for v in ids if v != "p3")
    assert staged.count("marked") <= 3
