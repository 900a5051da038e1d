"""Tables that change by small steps: merged when they are read, not rewritten when they change.

A table is a list of folders, the first of which is its base; each later one holds
the rows that one step has changed, with a mark on rows that it has deleted. The
newest row of a key counts. Rows lie in sub-folders by ranges of their id, so that a
scan of a UUID range opens the folders of that range only.

A step writes its changed rows, then one small file that names the folders of every
table; that file, written last, is what commits it. Folders whose sizes are near to
one another are merged, the newest first, so there are few of them (their number
grows with the logarithm of the rows) and a row is written again only when what it
is merged with has grown as large as its own folder.
"""

from __future__ import annotations

import dataclasses
import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.operators import index
from webloom.schema import DOCUMENTS, EDGES, LINKS

SCORES = T.StructType([T.StructField("link_id", T.StringType()), T.StructField("pagerank", T.DoubleType())])


@dataclasses.dataclass(frozen=True)
class _Kind:
    schema: T.StructType
    key: tuple[str, ...]
    range: str  # the id by whose ranges rows lie


_KINDS = {
    "links": _Kind(LINKS, ("url",), "id"),
    "edges": _Kind(EDGES, ("src", "dst"), "src"),
    "documents": _Kind(DOCUMENTS, ("link_id",), "link_id"),
    "scores": _Kind(SCORES, ("link_id",), "link_id"),
}

_DELETED, _PART, _ORDER = "__deleted", "__part", "__order"


def part_of(key: Column | str, parts: int):
    """Which of `parts` equal ranges of the UUID space an id is in; -1 for null. For a string, its number."""
    if isinstance(key, str):
        return int(key.replace("-", "")[:4], 16) * parts >> 16
    return F.coalesce(F.floor(F.conv(F.substring(F.replace(key, F.lit("-"), F.lit("")), 1, 4), 16, 10).cast("long") * parts / 65_536).cast("int"), F.lit(-1))


class GraphState:
    """Links, edges, documents and their scores below one folder, in any store that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 3, parts: int = 8):
        """keep: versions that stay for readers who began with them; parts: ranges of ids in which rows lie."""
        self.spark, self.path, self.keep, self.parts = spark, path.rstrip("/"), keep, parts
        self._known: dict[int, str] = {}

    def _at(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        files, path = self._at(folder)
        return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []

    def _remove(self, name: str) -> None:
        files, path = self._at(name)
        files.delete(path, True)

    def versions(self) -> dict[int, bool]:
        """Every version that stays, with whether it is committed."""
        numbers = [int(name[1:]) for name in self._names("") if name.startswith("v") and name[1:].isdigit()]
        return {n: self._committed(n) for n in sorted(numbers)}

    def _committed(self, version: int) -> bool:
        files, path = self._at(f"v{version}/committed/_SUCCESS")
        return files.exists(path)

    @property
    def version(self) -> int:
        """The last committed version, -1 before the first."""
        return max((n for n, done in self.versions().items() if done), default=-1)

    def _notes(self, version: int | None = None) -> dict:
        """{"batches": last micro-batch by source, "tables": [[folder, rows], …] by table}."""
        version = self.version if version is None else version
        if version < 0:
            return {"batches": {}, "tables": {name: [] for name in _KINDS}}
        if version not in self._known:  # what is committed stays as it is
            files, folder = self._at(f"v{version}/committed")
            part = next(s.getPath() for s in files.listStatus(folder) if s.getPath().getName().startswith("part-"))
            stream = files.open(part)
            try:
                self._known[version] = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
        return json.loads(self._known[version])

    def batch(self, source: str) -> int:
        """The last micro-batch of a source that went in, -1 before the first."""
        return self._notes()["batches"].get(source, -1)

    # Reading

    def _folder(self, name: str, folder: str, bounds: tuple[str, str] | None) -> DataFrame:
        schema = T.StructType([*_KINDS[name].schema.fields, T.StructField(_DELETED, T.BooleanType()), T.StructField(_PART, T.IntegerType())])
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/data/{name}/{folder}")
        if bounds is not None:
            key = F.col(_KINDS[name].range)
            rows = rows.where(F.col(_PART).between(part_of(bounds[0], self.parts), part_of(bounds[1], self.parts)) & (key >= bounds[0]) & (key < bounds[1]))
        return rows.drop(_PART)

    def _newest(self, name: str, folders: list, bounds: tuple[str, str] | None = None) -> DataFrame:
        """One row for each key of some folders: that of the last folder; deleted ones included."""
        kind = _KINDS[name]
        parts = [self._folder(name, folder, bounds) for folder, _ in folders]
        if len(parts) == 1:
            return parts[0]
        every = reduce(DataFrame.unionByName, (p.withColumn(_ORDER, F.lit(i)) for i, p in enumerate(parts)))
        rest = [c for c in parts[0].columns if c not in kind.key]
        newest = every.groupBy(*kind.key).agg(F.max_by(F.struct(*rest), _ORDER).alias("n"))
        return newest.select(*kind.key, *(F.col(f"n.{c}").alias(c) for c in rest))

    def _merged(self, name: str, notes: dict, bounds: tuple[str, str] | None = None) -> DataFrame:
        kind, folders = _KINDS[name], notes["tables"][name]
        columns = kind.schema.fieldNames()
        if not folders:
            return self.spark.createDataFrame([], kind.schema)
        base = self._folder(name, folders[0][0], bounds).where(~F.col(_DELETED)).select(*columns)
        if len(folders) == 1:
            return base
        # The base is read as it lies; only the keys that have changed since are taken out of it.
        changed = self._newest(name, folders[1:], bounds)
        same = [F.col(f"o.{c}").eqNullSafe(F.col(f"c.{c}")) for c in kind.key]
        old = base.alias("o").join(changed.select(*kind.key).alias("c"), same, "left_anti")
        return old.unionByName(changed.where(~F.col(_DELETED)).select(*columns))

    def table(self, name: str, start: str | None = None, end: str | None = None) -> DataFrame:
        """A table, or its rows with start <= id < end (for edges, the id of the source)."""
        return self._merged(name, self._notes(), None if start is None else (start, end))

    def read(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(links, edges, documents) of the last version; documents have their newest scores."""
        notes = self._notes()
        links, edges, documents, scores = (self._merged(name, notes) for name in _KINDS)
        return links, edges, index.update_scores(documents, scores) if notes["tables"]["scores"] else documents

    # Writing

    def _store(self, name: str, rows: DataFrame, version: int) -> list | None:
        """[folder, rows] of rows that were written; None if there were none."""
        folder = f"{version}-{uuid.uuid4().hex[:12]}"
        at = f"{self.path}/data/{name}/{folder}"
        placed = rows.withColumn(_PART, part_of(F.col(_KINDS[name].range), self.parts))
        seen = Observation()
        placed = placed.repartition(self.parts, _PART).sortWithinPartitions(_PART, _KINDS[name].range).observe(seen, F.count(F.lit(1)).alias("n"))
        placed.write.partitionBy(_PART).parquet(at)
        count = seen.get["n"]
        if not count:
            self._remove(f"data/{name}/{folder}")
        return [folder, count] if count else None

    def _settled(self, name: str, folders: list, version: int) -> list:
        """The folders of a table, with the newest ones merged where an older one is at most twice as large as all that follow it."""
        for i in range(len(folders) - 1):
            if folders[i][1] <= 2 * sum(n for _, n in folders[i + 1 :]):
                if i == 0:
                    rows = self._merged(name, {"tables": {name: folders}}).withColumn(_DELETED, F.lit(False))
                else:
                    rows = self._newest(name, folders[i:])
                merged = self._store(name, rows, version)
                return folders[:i] + ([merged] if merged else [])
        return folders

    def write(self, links: DataFrame, edges: DataFrame, documents: DataFrame, source: str | None = None, batch: int = -1, changes: bool = False, removed_edges: DataFrame | None = None, scores: DataFrame | None = None) -> int:
        """Commit a new version; the version.

        The tables are whole ones, or with `changes` the rows that are new or have
        changed; `removed_edges` (src, dst) go, and `scores` (link_id, pagerank) are set.
        """
        version = max(self.versions(), default=-1) + 1
        notes = self._notes() if changes else {"batches": self._notes()["batches"], "tables": {name: [] for name in _KINDS}}
        given = {"links": links, "edges": edges, "documents": documents, "scores": scores}
        for name, rows in given.items():
            if rows is None:
                continue
            rows = rows.select(*_KINDS[name].schema.fieldNames()).withColumn(_DELETED, F.lit(False))
            if name == "edges" and removed_edges is not None:
                gone = removed_edges.select(F.lit(None).cast("string").alias("id"), "src", "dst", F.lit(None).cast("timestamp").alias("updated_at"), F.lit(True).alias(_DELETED))
                rows = rows.unionByName(gone)
            if stored := self._store(name, rows, version):
                notes["tables"][name] = self._settled(name, notes["tables"][name] + [stored], version)
        if source is not None:
            notes["batches"][source] = batch
        self.spark.createDataFrame([(json.dumps(notes),)], "value string").coalesce(1).write.text(f"{self.path}/v{version}/committed")
        self._clean()
        return version

    def set_scores(self, scores: DataFrame) -> int:
        """Commit scores (link_id, pagerank); documents are not written again."""
        return self.write(None, None, None, None, -1, True, None, scores)

    def _clean(self) -> None:
        """Remove versions beyond those that are kept, and what no kept version names."""
        for old in sorted(self.versions())[: -self.keep]:
            self._remove(f"v{old}")
        kept = [self._notes(n) for n, done in self.versions().items() if done]
        for name in _KINDS:
            named = {folder for notes in kept for folder, _ in notes["tables"][name]}
            for folder in self._names(f"data/{name}"):
                if folder not in named and int(folder.split("-")[0]) <= self.version:
                    self._remove(f"data/{name}/{folder}")
