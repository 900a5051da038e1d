"""Near-duplicate documents: a chosen-path set similarity join on shingle sets.

1. Equal shingle sets collapse to one representative, so exact copies never meet.
2. Trees branch the representatives: at a node, a coordinate of the minwise
   sketch is chosen by the node's own hash, with a second one in as many nodes as
   keep a pair of the wanted similarity together on one path on average; a
   document goes to the child named by each chosen value. Every tree has
   coordinates of its own, so trees are independent, and there are as many as
   bring the chance to miss such a pair in all of them to MISS (`trees_for`).
   A set has trees * (1 / similarity) ** depth member rows: 17 at 10 ** 5 sets,
   41 at 10 ** 8, 80 at 10 ** 10.
3. Nodes of at most NODE members are compared exhaustively by sketch. Larger
   ones branch again for as long as that shrinks them. What is left are groups of
   near copies. Those of up to GRID blocks are compared in a grid of blocks. In
   larger ones members are tied to pivots in one pass each, and those close to a
   pivot leave the node, as whatever they are linked with is itself a candidate
   of the pivot; only what pivots do not shrink goes to the grid.
   A spanning forest of each node's candidate links leaves it.
4. The candidates' connected groups are confirmed on full sets. Groups of up to
   GRID blocks are compared exhaustively, a pair of blocks in one task. In larger
   ones the candidate links are confirmed first, a star's leaves in bounded parts;
   then only sets outside a group's largest linked part are compared with all of
   the group, in blocks. So a family of near copies costs in proportion to its
   size and to the number of its sets that are not linked with the rest.

No pair list of a group is ever made, and no group meets in one task unless it
is below a fixed size.

Texts of null or without words have an empty set and stand alone. doc_id must
be an integer; rows with one doc_id count as one document, so differing texts
under it are linked. Rows of null doc_id take part through their equal texts
only, and have a null component otherwise. Repeated rows each get the row of their
doc_id. An empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm import common, shingles
from webloom.llm.components import Forest, components

#: Members of a node that one task compares; rows of a block of a larger one; sets of a block; leaves of a star in one task; blocks of a group that is compared in a grid.
NODE, BLOCK, SET_BLOCK, LEAVES, GRID = 512, 384, 256, 256, 16

#: Sketches are candidates down to so much below the wanted similarity, about five standard errors. Those so close to a pivot leave their node.
MARGIN, CLOSE = 0.25, 0.9

#: Chance to miss a pair of just the wanted similarity in all trees.
MISS = 1e-4

#: Share of members that a level, or a pass of pivots, may keep in large nodes for another one to follow.
SHRINKS = 0.75

_MEMBERS = "rid long, node long, nibbles binary"
_TREES = np.uint64(63)  # the bits of a node that name its tree


def features(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, sketch); the last two null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in common.chunks(batches):
            sizes, keys, sketches = [], [], []
            for text in texts:
                found = shingles.shingle_set(text, width)
                sizes.append(len(found))
                keys.append(shingles.set_key(found) if len(found) else None)
                sketches.append(shingles.sketch(found).tobytes() if len(found) else None)
            columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set_key", "sketch"])

    texts = common.doc_texts(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    return texts.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sketch binary")


def _fixed(rows: np.ndarray) -> pa.Array:
    """A binary column from the rows of a matrix of bytes."""
    n, wide = rows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * wide
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _matrix(column: pa.Array, kind, wide: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, wide)


def trees_for(depth: int, similarity: float) -> int:
    """How many trees miss a pair of this similarity with probability MISS at most, by the branching process of its common paths."""
    missed, second = 0.0, min(1.0, 1 / similarity - 1)
    for _ in range(depth):
        alone = 1 - similarity + similarity * missed
        missed = (1 - second) * alone + second * alone * alone
    return min(int(_TREES), max(2, math.ceil(math.log(MISS) / math.log(min(0.99, max(1e-9, missed))))))


def roots(trees: int) -> np.ndarray:
    return shingles.mix(np.arange(1, trees + 1, dtype=np.uint64)) & ~_TREES | np.arange(trees, dtype=np.uint64)


def _children(nodes: np.ndarray, sketches: np.ndarray, trees: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child node) of every child of the node that each row is in."""
    pool = np.uint64(shingles.COORDINATES // trees)
    tree = nodes & _TREES
    one = (nodes >> np.uint64(8)) % pool
    two = (one + np.uint64(1) + (nodes >> np.uint64(20)) % max(np.uint64(1), pool - np.uint64(1))) % pool
    more = (nodes >> np.uint64(40)) < np.uint64(int(min(1.0, 1 / similarity - 1) * (1 << 24)))

    def child(rows: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        at = tree[rows] * pool + chosen
        value = sketches[rows, at.astype(np.int64)].astype(np.uint64)
        return shingles.mix(nodes[rows] * np.uint64(0x9E3779B97F4A7C15) + (at << np.uint64(32)) + value) & ~_TREES | tree[rows]

    rows, some = np.arange(len(nodes)), np.flatnonzero(more)
    return np.concatenate([rows, some]), np.concatenate([child(rows, one), child(some, two[some])])


def _members(ids: np.ndarray, rows: np.ndarray, nodes: np.ndarray, sketches: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Member rows: the set of each of `rows` in its node."""
    small = shingles.nibbles(sketches)
    for at in range(0, len(rows), 50_000):
        own = rows[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(nodes[at : at + 50_000].view(np.int64)), _fixed(small[own])], names=["rid", "node", "nibbles"])


def plant(sets: DataFrame, trees: int, depth: int, similarity: float) -> DataFrame:
    """Members of the nodes at `depth` of every tree."""
    first = roots(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                sketches = _matrix(part.column("sketch"), np.uint32, shingles.COORDINATES)
                rows, nodes = np.tile(np.arange(len(sketches)), trees), np.repeat(first, len(sketches))
                for _ in range(depth):
                    of, nodes = _children(nodes, sketches[rows], trees, similarity)
                    rows = rows[of]
                yield from _members(part.column("rid").to_numpy(), rows, nodes, sketches)

    return sets.select("rid", "sketch").mapInArrow(run, _MEMBERS)


def branch(active: DataFrame, sets: DataFrame, trees: int, similarity: float) -> DataFrame:
    """Members of the children of the nodes that `active` rows are in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sketches = _matrix(batch.column("sketch"), np.uint32, shingles.COORDINATES)
            rows, nodes = _children(batch.column("node").to_numpy().view(np.uint64), sketches, trees, similarity)
            yield from _members(batch.column("rid").to_numpy(), rows, nodes, sketches)

    return active.select("rid", "node").join(sets.select("rid", "sketch"), "rid").mapInArrow(run, _MEMBERS)


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by `key`; only the last group of a batch waits for more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        last = int(np.searchsorted(keys, keys[-1]))
        if held and held[0].column(key)[0].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _forest(ids: np.ndarray, one: np.ndarray, two: np.ndarray) -> list[tuple[int, int]]:
    forest = Forest()
    a, b = ids[one].tolist(), ids[two].tolist()
    return [(x, y) for x, y in zip(a, b) if forest.join(x, y)]


def _all_pairs(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of every pair inside each of the given runs of rows."""
    one, two = [], []
    for size in np.unique(sizes):
        i, j = np.triu_indices(size, 1)
        first = starts[sizes == size]
        one.append((first[:, None] + i).ravel())
        two.append((first[:, None] + j).ravel())
    return np.concatenate(one), np.concatenate(two)


def _exhaust(ids: np.ndarray, small: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Forest of the candidate links of one larger node. Members outside the
    largest part found so far meet all members; pairs inside one part need not."""
    n = len(ids)
    label, met, edges = np.arange(n), np.zeros(n, bool), []
    while True:
        largest = np.bincount(label).argmax()
        waiting = np.flatnonzero(~met & (label != largest))
        if not len(waiting):
            return edges
        for i in waiting[:32]:
            met[i] = True
            close = np.flatnonzero(shingles.similarity(small[i], small) >= least)
            for other in np.unique(label[close]):
                if other != label[i]:
                    j = close[label[close] == other][0]
                    edges.append((int(ids[i]), int(ids[j])))
                    label[label == other] = label[i]


def compare(members: DataFrame, least: float) -> DataFrame:
    """Candidate links (a, b), of sketches at least so similar, of every node, all of bounded size: a forest per node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "node"):
            keys = group.column("node").to_numpy()
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            sizes = np.diff(np.append(starts, len(keys)))
            if not (sizes > 1).any():
                continue
            ids = group.column("rid").to_numpy()
            small = _matrix(group.column("nibbles").combine_chunks(), np.uint8, shingles.COMPARED // 2)
            edges: list[tuple[int, int]] = []
            for s, n in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist()):
                edges += _exhaust(ids[s : s + n], small[s : s + n], least)
            few = np.flatnonzero((sizes > 1) & (sizes <= 64))
            work = np.cumsum(sizes[few] * (sizes[few] - 1) // 2)
            for part in np.split(few, np.searchsorted(work, np.arange(200_000, int(work[-1]) if len(work) else 0, 200_000))):
                if len(part):
                    one, two = _all_pairs(starts[part], sizes[part])
                    close = shingles.similarity(small[one], small[two]) >= least
                    edges += _forest(ids, one[close], two[close])
            edges = list({(min(e), max(e)) for e in edges})
            if edges:
                a, b = zip(*edges)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    # In order of rid, so that a group has the same forest in every node that holds it.
    return members.repartition("node").sortWithinPartitions("node", "rid").mapInArrow(run, "a long, b long")


def _grid(rows: DataFrame, group: str, size: str, block: int, key: str) -> DataFrame:
    """`rows` once per pair of blocks that theirs is in; `key` names the pair. Groups of one block stay as they are."""
    blocks = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64("rid", F.lit(7)), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    spread = rows.withColumn("own", own).withColumn("other", other)
    return spread.withColumn(key, F.xxhash64(group, F.least("own", "other"), F.greatest("own", "other"))).drop("own", "other")


def _in_grid(active: DataFrame, least: float) -> DataFrame:
    """Candidate links of large nodes (with their size n), all against all in pairs of blocks."""
    return compare(_grid(active, "node", "n", BLOCK, "pair").drop("node").withColumnRenamed("pair", "node"), least)


def near_pivots(active: DataFrame, round_: int) -> DataFrame:
    """The rows of nodes with a pivot for each node and how similar to it they are."""
    order = F.struct(F.xxhash64("rid", F.lit(round_)).alias("h"), "rid", "nibbles")
    pivots = active.groupBy("node").agg(F.min(order).alias("p")).select("node", F.col("p.rid").alias("pivot"), F.col("p.nibbles").alias("of_pivot"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, two = (_matrix(batch.column(c), np.uint8, shingles.COMPARED // 2) for c in ("nibbles", "of_pivot"))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rid", "node", "nibbles", "pivot")), pa.array(shingles.similarity(one, two))], names=["rid", "node", "nibbles", "pivot", "alike"])

    return active.select("rid", "node", "nibbles").join(pivots, "node").mapInArrow(run, _MEMBERS + ", pivot long, alike double")


def _by_pivots(active: DataFrame, least: float) -> list[DataFrame]:
    """Candidate links of large nodes that branching does not shrink."""
    few = F.col("n") <= GRID * BLOCK
    found, round_ = [_in_grid(active.where(few), least)], 0
    active = active.where(~few)
    rows = active.count()
    while rows:
        round_ += 1
        met = common.stage(near_pivots(active, round_), "pivots")
        found.append(met.where((F.col("alike") >= least) & (F.col("rid") != F.col("pivot"))).select(F.least("rid", "pivot").alias("a"), F.greatest("rid", "pivot").alias("b")))
        rest = met.where(F.col("alike") < CLOSE).select("rid", "node", "nibbles")
        sizes = rest.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
        active = common.stage(rest.join(sizes, "node"), "active")
        left = active.where(~few).count()
        if left > SHRINKS * rows:
            found.append(_in_grid(active, least))
            break
        found.append(_in_grid(active.where(few), least))
        active, rows = active.where(~few), left
    return found


def candidates(sets: DataFrame, n_sets: int, similarity: float, trees: int | None = None) -> DataFrame:
    """Candidate links (a, b), whose connected groups hold every pair of at least `similarity` (up to the trees' recall)."""
    depth = max(1, math.ceil(math.log(max(2, n_sets) / 64) / math.log(20)))
    trees, least = trees or trees_for(depth, similarity), similarity - MARGIN
    members, found, before = plant(sets, trees, depth, similarity), [], None
    while True:
        counts = members.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > NODE)
        large = common.stage(counts, "large")
        rows = large.agg(F.sum("n")).first()[0]
        if not rows:
            found.append(compare(members, least))
            break
        if before is not None and rows > SHRINKS * before[1]:
            found += _by_pivots(before[0], least)  # branching no longer helps
            break
        found.append(compare(members.join(large.select("node"), "node", "left_anti"), least))
        active = common.stage(members.join(large, "node").select("rid", "node", "nibbles", "n"), "active")
        before, members = (active, rows), branch(active, sets, trees, similarity)
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges.distinct()


def _full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(rid, root, n, hashes) of the documents in `wanted` (rid, root, n)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                hashes = [shingles.shingle_set(t, width).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("root"), part.column("n"), pa.array(hashes, pa.binary())], names=["rid", "root", "n", "hashes"])

    texts = common.doc_texts(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    # A merge join at every size: candidates grow with the corpus, so they are no table to broadcast.
    return texts.join(wanted.withColumnRenamed("rid", "doc_id").hint("merge"), "doc_id").mapInArrow(sets, "rid long, root long, n long, hashes binary")


def _links_in(blocks: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) confirmed among the sets (pair, rid, hashes) of each pair of blocks, a forest of each."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "pair"):
            keys = group.column("pair").to_numpy()
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])).tolist()
            ids, hashes = group.column("rid").to_numpy(), group.column("hashes")  # its chunks are not copied together
            edges: list[tuple[int, int]] = []
            for s, e in zip(starts, [*starts[1:], len(keys)]):
                edges += _linked(ids[s:e], [np.frombuffer(hashes[i].as_py(), np.uint64) for i in range(s, e)], percent)
            if edges:
                a, b = zip(*edges)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return blocks.select("pair", "rid", "hashes").repartition("pair").sortWithinPartitions("pair").mapInArrow(links, "a long, b long")


def _confirmed_stars(edges: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The links among `edges` (a, b) that hold on full sets; a task meets one end and a bounded number of its others at a time."""
    both = edges.select(F.col("a").alias("v")).unionByName(edges.select(F.col("b").alias("v"))).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    ends = edges.join(both.select(F.col("v").alias("a"), F.col("n").alias("na")), "a").join(both.select(F.col("v").alias("b"), F.col("n").alias("nb")), "b")
    centre = F.when(F.col("na") >= F.col("nb"), F.struct(F.col("a").alias("c"), F.col("b").alias("v"), F.col("na").alias("n"))).otherwise(F.struct(F.col("b").alias("c"), F.col("a").alias("v"), F.col("nb").alias("n")))
    parts = F.ceil(F.col("n") / LEAVES).cast("int")
    leaves = ends.select(centre.alias("e")).select("e.*").withColumn("part", F.pmod(F.xxhash64("v"), parts).cast("int"))
    leaves = common.stage(leaves.select("c", "v", "part"), "leaves")
    rows = leaves.select("c", "part", F.col("v").alias("rid"), F.lit(True).alias("leaf")).unionByName(leaves.select("c", "part", F.col("c").alias("rid"), F.lit(False).alias("leaf")).distinct())
    rows = rows.join(full.select("rid", "hashes"), "rid").withColumn("key", F.xxhash64("c", "part"))

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, mine = None, [], -1
        for batch in batches:
            found = []
            for k, rid, leaf, hashes in zip(*(batch.column(c).to_pylist() for c in ("key", "rid", "leaf")), batch.column("hashes")):
                some = np.frombuffer(hashes.as_py(), np.uint64)
                if not leaf:
                    own = [*own, some] if k == key and rid == mine else [some]  # a doc_id may have several sets
                    key, mine = k, rid
                elif k == key and any(_alike(x, some, percent) for x in own):
                    found.append((mine, rid))
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.repartition("key").sortWithinPartitions("key", "c", "part", "leaf").mapInArrow(links, "a long, b long")


def _across_parts(full: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Links between the linked parts (v, part) of each group: every set outside its group's largest part meets the whole group, in blocks."""
    marked = full.join(parts.withColumnRenamed("v", "rid"), "rid")
    sizes = parts.join(full.select(F.col("rid").alias("v"), "root"), "v").groupBy("root", "part").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.groupBy("root").agg(F.max(F.struct("size", "part")).alias("m"), F.sum("size").alias("all")).where(F.col("m.size") < F.col("all"))
    groups = largest.select("root", F.col("m.part").alias("most"), F.ceil((F.col("all") - F.col("m.size")) / SET_BLOCK).cast("int").alias("probes"), F.ceil(F.col("all") / SET_BLOCK).cast("int").alias("targets"))
    open_ = marked.join(groups, "root")
    probe, target = (F.pmod(F.xxhash64("rid", F.lit(k)), F.col(c)).cast("int") for k, c in ((11, "probes"), (12, "targets")))
    outside = open_.where("part <> most").select("root", "rid", "hashes", probe.alias("p"), F.explode(F.sequence(F.lit(0), F.col("targets") - 1)).alias("t"))
    every = open_.select("root", "rid", "hashes", F.explode(F.sequence(F.lit(0), F.col("probes") - 1)).alias("p"), target.alias("t"))
    return _links_in(outside.unionByName(every).withColumn("pair", F.xxhash64("root", "p", "t")), percent)


def confirm(docs: DataFrame, edges: DataFrame, groups: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) that hold on full sets and connect whatever is linked; `edges` are the candidates, groups has (v, root) of them."""
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    wanted = groups.join(sizes, "root").select(F.col("v").alias("rid"), "root", "n")
    few = F.col("n") <= GRID * SET_BLOCK
    found = _links_in(_grid(_full_sets(docs, wanted.where(few), width), "root", "n", SET_BLOCK, "pair"), percent)
    large = wanted.where(~few)
    if large.isEmpty():
        return found
    full = common.stage(_full_sets(docs, large, width), "full-sets")
    own = edges.join(large.select(F.col("rid").alias("a")), "a", "left_semi")
    stars = common.stage(_confirmed_stars(own, full, percent), "confirmed")
    parts = full.select(F.col("rid").alias("v")).join(components(stars), "v", "left").select("v", F.coalesce("root", "v").alias("part"))
    return found.unionByName(stars).unionByName(_across_parts(full, common.stage(parts.distinct(), "parts"), percent))


def _alike(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    at = np.minimum(np.searchsorted(one, two), len(one) - 1)
    inter = int((one[at] == two).sum())
    return 100 * inter >= percent * (len(one) + len(two) - inter)


def _linked(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Forest of the links of 100 * intersection >= percent * union among a few sets."""
    n = len(sets)
    lengths = np.fromiter(map(len, sets), np.int64, n)
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), lengths)
    shared = counts > 1  # what only one set holds is in no intersection
    number = np.cumsum(shared) - 1
    keep = shared[inverse]
    column, owner = number[inverse][keep], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((n, n), np.float32)
    wide = max(1, 4_000_000 // n)
    for at in range(0, int(shared.sum()), wide):
        low, high = np.searchsorted(column, [at, at + wide])
        held = np.zeros((n, min(wide, int(shared.sum()) - at)), np.float32)
        held[owner[low:high], column[low:high] - at] = 1
        both += held @ held.T
    inter = both.astype(np.int64)
    union = lengths[:, None] + lengths[None, :] - inter
    one, two = np.nonzero(np.triu(100 * inter >= percent * union, 1))
    return _forest(ids, one, two)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, trees: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row."""
    found = common.stage(features(docs, width), "features")
    identified = found.where("set_key is not null and doc_id is not null")
    # One row per distinct set, under its smallest doc_id.
    sets = common.stage(identified.groupBy("set_key").agg(F.min("doc_id").alias("rid"), F.first("sketch").alias("sketch")), "sets")
    n_sets = sets.count()
    edges = common.stage(candidates(sets, n_sets, percent / 100, trees), "candidates")
    groups = common.stage(components(edges), "groups")
    confirmed = confirm(docs, edges, groups, width, percent)
    # A doc_id under several sets is one vertex; its row in `sets` repeats, which links them.
    # Staged, as two Python functions in one stage take two workers for each task, which stay.
    joined = components(common.stage(confirmed, "confirmed"))
    named = sets.select("set_key", "rid").join(joined.withColumnRenamed("v", "rid"), "rid", "left")
    named = named.select("set_key", F.coalesce("root", "rid").alias("component_id"))
    out = found.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
