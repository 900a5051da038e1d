"""Operators on the whole corpus: near duplicates, quality, and the pipeline."""

import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from webloom.llm import components, decontaminate, near_dup, quality_model, quality_rules, queries, secret_scan, shingles, text_stats
from webloom.llm.labelled import holds, sample

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def brute_components(rows, width, percent=80):
    sets = {d: set(shingles.shingle_set(t or "", width).tolist()) for d, t in rows}
    parent = {d: d for d in sets}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, width):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute_components(rows, width)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(docs, width).collect()}
    assert got == want


def changed(rng, size, changes, word="w"):
    """A text of `size` words in which some have been replaced by words of their own."""
    words = [f"{word}{k}" for k in range(size)]
    for k in rng.choice(size, changes, replace=False):
        words[k] = f"x{rng.integers(1_000_000_000)}"
    return " ".join(words)


@pytest.mark.parametrize("shrinks", [0.98, 0.0])
def test_large_nodes_and_blocks(spark, monkeypatch, shrinks):
    """Groups of near copies above the size of a node, of a block and of a star's part: by pivots, and by the grid where these do not help."""
    for name, value in (("NODE", 12), ("BLOCK", 8), ("SET_BLOCK", 8), ("LEAVES", 5), ("GRID", 2), ("SHRINKS", shrinks)):
        monkeypatch.setattr(near_dup, name, value)
    rng = np.random.default_rng(5)
    rows = [(i, changed(rng, 120, int(rng.integers(0, 9)))) for i in range(90)]
    rows += [(100 + i, " ".join(f"y{rng.integers(1_000_000)}" for _ in range(50))) for i in range(60)]
    # Chains whose ends are far apart, so that no pivot is near all of a chain.
    rows += [(200 + 40 * c + i, " ".join(f"z{c}_{k}" for k in range(4 * i, 4 * i + 60))) for c in range(3) for i in range(30)]
    want = brute_components(rows, 2)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(frame, 2).collect()}
    assert got == want


def test_recall_just_above_the_limit(spark):
    """Pairs of similarity 161 / 201, the least there is above 0.8 for their size."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(1_500):
        words = [f"p{i}_{k}" for k in range(182)]
        other = list(words)
        for k in rng.choice(np.arange(1, 180, 3), 10, replace=False):
            other[k] = f"q{i}_{k}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    one, two = (shingles.shingle_set(rows[k][1], 2) for k in (0, 1))
    assert (len(np.intersect1d(one, two)), len(np.union1d(one, two))) == (161, 201)
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2)
    assert found.where("component_id = doc_id - doc_id % 2").count() >= 0.999 * len(rows)


def test_trees_reach_their_recall():
    """Paths of pairs whose sketches agree in eight of ten coordinates, at every depth."""
    rng, n = np.random.default_rng(4), 4_000
    one = rng.integers(0, 1 << 32, (n, shingles.COORDINATES), dtype=np.uint32)
    two = np.where(rng.random(one.shape) < 0.8, one, rng.integers(0, 1 << 32, one.shape, dtype=np.uint32))
    for depth in (1, 3, 5, 7):
        trees, met, members = near_dup.trees_for(depth, 0.8), np.zeros(n, bool), 0
        for root in near_dup.roots(trees):
            sides = []
            for sketches in (one, two):
                rows, nodes = np.arange(n), np.full(n, root)
                for _ in range(depth):
                    of, nodes = near_dup._children(nodes, sketches[rows], trees, 0.8)
                    rows = rows[of]
                sides.append(set(zip(rows.tolist(), nodes.tolist())))
                members += len(rows) / 2
            met[[r for r, _ in sides[0] & sides[1]]] = True
        assert met.mean() >= 0.999 and members < 1.5 * n * trees * 1.25**depth


def test_near_duplicates_of_odd_rows(spark):
    rows = [(1, "a b c"), (2, "A b  c"), (3, None), (4, ""), (5, "  "), (6, "one"), (7, "one"), (7, "one"), (None, "a b c"), (None, "alone here"), (8, "z " * 100_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(0) for c in ("kept", "sketch", "rid", "node", "component_id")})
    got = sorted(map(tuple, near_dup.near_duplicates(frame, 2).collect()), key=repr)
    want = [(1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 1, 6, True), (7, 1, 6, False), (7, 1, 6, False), (8, 1, 8, True), (None, 1, None, True), (None, 2, 1, True)]
    assert got == sorted(want, key=repr)
    assert near_dup.near_duplicates(frame.limit(0), 2).count() == 0


def test_components(spark):
    chain = [(i + 1, i) for i in range(40)] + [(100, 102), (101, 102), (7, 7)]
    got = dict(components.components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert {got[i] for i in range(41)} == {0} and [got[i] for i in (100, 101, 102)] == [100] * 3


def test_components_of_hot_vertices(spark, monkeypatch):
    monkeypatch.setattr(components, "HOT_ROWS", 4)
    edges = [(0, i) for i in range(1, 400, 2)] + [(399, i) for i in range(2, 400, 2)] + [(1000 + i, 1001 + i) for i in range(9)]
    frame = spark.createDataFrame(edges, "a long, b long").repartition(16)
    got = dict(components.components(frame).collect())
    assert {got[i] for i in range(400)} == {0} and {got[1000 + i] for i in range(10)} == {1000}


def test_rule_lists_learn():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 9))
    y = (~((x[:, 2] > 0.8) | ((x[:, 0] < 0.3) & (x[:, 4] > 0.5)))).astype(int)
    rules = quality_rules.learn(x, y, rng.random(3000) < 1 / 3)
    bad = np.any([holds(x, r) for r in rules], 0)
    assert (bad == (y == 0)).mean() > 0.97
    model = quality_model.learn(x, y)
    assert ((model.predict(x) >= 0.5) == y).mean() > 0.97 and len(model.rules) <= quality_model.MAX_RULES
    assert quality_rules.learn(x, np.ones(3000, int), rng.random(3000) < 0.5) == []
    assert quality_model.learn(x[:0], y[:0]).predict(x[:1]) == [0.5]


def test_quality(spark, docs, labels):
    scored = quality_model.quality_scores(docs, labels)
    rows = scored.join(labels, "doc_id").collect()
    assert scored.count() == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.9
    kept = quality_rules.quality_rules(docs, labels)
    assert kept.where("base_failed and kept").count() == 0 and kept.count() == docs.count()


def test_quality_of_odd_rows(spark, labels):
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x"), (4, "word " * 50_000)], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("score", "quality", "kept", "n_words", "label")})
    none = labels.limit(0)
    for judged in (quality_rules.quality_rules(odd, none), quality_rules.quality_rules(odd, labels)):
        assert judged.count() == 6 and judged.where("kept").count() == 0
    assert {r["score"] for r in quality_model.quality_scores(odd, none).collect()} == {0.5}
    assert quality_model.quality_scores(odd.limit(0), labels).count() == 0
    dotted = odd.withColumnRenamed("label", "a.`b")
    assert quality_model.keep(dotted, quality_model.Ensemble(1.0, [])).columns == dotted.columns


def test_learned_rules_on_unseen_documents(spark):
    """Fitted on sf0.01: the list is not empty, errs less than the base filter alone, and each row is judged as a plain reading of the rules says; the same for the ensemble."""
    where = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{where}/{t}.parquet") for t in ("documents", "labels"))
    rules, model = quality_rules.fit(docs, labels), quality_model.fit(docs, labels)
    names = [f"f_{n}" for n in text_stats.FEATURES]
    features = {r["doc_id"]: [r[n] for n in names] for r in text_stats.with_features(docs, "doc_id").select("doc_id", *names).collect()}

    def true(rule, x):
        return all((x[f] > t) == above for f, t, above in rule)

    judged = {r["doc_id"]: r for r in quality_rules.judge(docs, rules).collect()}
    assert rules and all(r["kept"] == (not r["base_failed"] and not any(true(rule, features[d]) for rule in rules)) for d, r in judged.items())
    scored = {r["doc_id"]: r for r in quality_model.score(docs, model).collect()}
    for d, r in scored.items():
        total = model.intercept + sum(w for w, rule in model.rules if true(rule, features[d]))
        assert abs(r["score"] - 1 / (1 + np.exp(-total))) < 1e-9
    unseen = [(r["doc_id"], r["quality"]) for r in labels.collect() if r["quality"] is not None and scored[r["doc_id"]]["held_out"]]
    wrong = sum(judged[d]["kept"] != (q == 1) for d, q in unseen)
    assert wrong < sum(judged[d]["base_failed"] != (q == 0) for d, q in unseen) and wrong <= 0.06 * len(unseen)
    assert sum(scored[d]["predicted"] != q for d, q in unseen) <= 0.02 * len(unseen)


def test_repeated_labels_and_documents(spark):
    docs = spark.createDataFrame([(1, f"one {k}") for k in range(50)] + [(2, "two"), (3, "three")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, None)], "doc_id long, quality int")
    x, y, _ = sample(docs, labels)
    own = [d for d in (1, 2) if zlib.crc32(str(d).encode()) % 3 != 1]
    assert len(x) == len(own) and sorted(y) == sorted({1: 1, 2: 0}[d] for d in own)


def test_pipeline(spark, docs, labels):
    """Every stage against a plain version of its decision on its own input."""
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    windows = decontaminate.Windows([tuple(r) for r in bench.select("item_id", "text").collect()], 10)
    inputs = [docs]
    for _, stage in corpus_pipeline.STAGES:
        inputs.append(stage(spark, inputs[-1], SF).cache())
    raw, good, unique, clean, masked, tokens = inputs
    for frame in (good, unique, clean, masked):
        assert frame.columns == docs.columns
    model = quality_model.fit(docs, labels)
    assert sorted(r["doc_id"] for r in good.collect()) == sorted(r["doc_id"] for r in quality_model.score(docs, model).where("predicted = 1").collect())
    groups = brute_components([(r["doc_id"], r["text"]) for r in good.collect()], 5)
    assert sorted(r["doc_id"] for r in unique.collect()) == sorted(d for d, (_, root) in groups.items() if d == root)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(r["doc_id"] for r in unique.collect() if not windows.scan(decontaminate.words(r["text"]))[0])
    assert {r["doc_id"]: r["text"] for r in masked.collect()} == {r["doc_id"]: secret_scan.mask(r["text"]) for r in clean.collect()}
    assert masked.where("n_chars <> length(text)").count() == 0 and tokens.count() == masked.count()
    whole = corpus_pipeline.run(spark, SF)
    assert collections.Counter(r["doc_id"] for r in whole.select("doc_id").collect()) == collections.Counter(r["doc_id"] for r in masked.collect())


def test_every_operator_has_a_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.queries())
    assert numbers == list(range(1, 14))
