"""A stored text index that is kept up to date in segments, and pages of it by rank or relevance with an early stop.

A segment holds the documents of one change: their postings in a folder for each
bucket of terms, their ids, and for each term and block of documents how many have
it, how often at most, and how short they are at least. Blocks are documents of near
ranks. A document that comes again, or is deleted, counts in its last segment only;
what it had added to the numbers of documents by term is taken off in that segment,
so that scores are those of an index made anew. Segments of near sizes are merged.

A page reads blocks by the best that they can hold, and ends when no other block
can reach it.
"""

from __future__ import annotations

import json
import math
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from webloom.operators import index
from webloom.operators.search import Page, ordered_tokens, phrase_hits
from webloom.storage import stage

#: Parameters of the relevance score (the usual ones of BM25).
K1, B = 1.2, 0.75

_DOCS = "link_id string, total long, block int, pagerank double, terms array<string>, alive boolean"
_STATS = "term string, block int, n_docs long, most long, shortest long, bucket int"
_POSTINGS = "term string, link_id string, field string, positions array<int>, n long, total long, block int, bucket int"
#: Postings as they are written: ids packed, and in the first row of a term and document how often it has the term in all its fields.
_STORED = "term string, link_id binary, field string, positions array<int>, n long, total long, block int, of_document long, bucket int"

_UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def _packed(link_id: Column) -> Column:
    """An id in bytes: a UUID in 16 behind a 1, any other as it is behind a 0."""
    whole = F.concat(F.unhex(F.lit("01")), F.unhex(F.replace(link_id, F.lit("-"), F.lit(""))))
    return F.when(link_id.rlike(_UUID), whole).otherwise(F.concat(F.unhex(F.lit("00")), link_id.cast("binary")))


def _unpacked(packed: Column) -> Column:
    digits = F.lower(F.hex(packed))
    uuid_ = F.concat_ws("-", *(F.substring(digits, a, n) for a, n in ((3, 8), (11, 4), (15, 4), (19, 4), (23, 12))))
    return F.when(F.startswith(packed, F.unhex(F.lit("01"))), uuid_).otherwise(F.substring(packed, 2, 2**31 - 1).cast("string"))


class TextIndex:
    """Segments below one folder, in any store that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str, blocks: int = 32):
        self.spark, self.path, self.blocks = spark, path.rstrip("/"), blocks

    # What is committed: a small file for each version, written last.

    def _files(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _version(self) -> int:
        files, path = self._files("versions")
        names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
        done = [int(n) for n in names if n.isdigit() and files.exists(self._files(f"versions/{n}/_SUCCESS")[1])]
        return max(done, default=-1)

    def _notes(self) -> dict:
        version = self._version()
        if version < 0:
            return {"version": -1, "segments": [], "ranks": None}
        return json.loads(self.spark.read.text(f"{self.path}/versions/{version}").first()[0])

    def _commit(self, notes: dict) -> None:
        notes = notes | {"version": notes["version"] + 1}
        self.spark.createDataFrame([(json.dumps(notes),)], "value string").coalesce(1).write.text(f"{self.path}/versions/{notes['version']}")

    def _read(self, segment: str, table: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{segment}/{table}")

    # Changes

    def upsert(self, documents: DataFrame) -> None:
        """Add documents (link_id, title, content, pagerank), or put them in the place of those of their ids; of repeated ids the greatest row counts."""
        named = documents.where("link_id is not null").select("link_id", F.coalesce("pagerank", F.lit(0.0)).alias("pagerank"), "title", "content")
        again = stage(named.groupBy("link_id").count().where("count > 1").select("link_id"), "repeated")
        if not again.isEmpty():
            # Only documents of repeated ids meet; the texts of the others are not shuffled.
            greatest = named.join(again, "link_id", "left_semi").groupBy("link_id").agg(F.max(F.struct("pagerank", "title", "content")).alias("d"))
            named = named.join(again, "link_id", "left_anti").unionByName(greatest.select("link_id", "d.*"))
        self._change(named, None)

    def delete(self, ids: DataFrame) -> None:
        """Remove documents (link_id)."""
        self._change(None, ids.select("link_id").distinct())

    def _change(self, documents: DataFrame | None, deleted: DataFrame | None) -> None:
        notes = self._notes()
        name = f"segment-{notes['version'] + 1}-{uuid.uuid4().hex[:8]}"
        if documents is None:
            documents = self.spark.createDataFrame([], "link_id string, pagerank double, title string, content string")
        segment = self._write(name, documents, deleted, notes["segments"])
        self._commit(notes | {"segments": self._settled(notes["segments"] + [segment], notes["version"] + 1)})

    def _write(self, name: str, documents: DataFrame, deleted: DataFrame | None, older: list[dict]) -> dict:
        """Write a segment over the older ones; what is noted of it."""
        ranks = documents.select(F.percentile_approx("pagerank", [i / self.blocks for i in range(1, self.blocks)], 1_000)).first()[0] or []
        cuts = F.array(*[F.lit(x) for x in sorted(set(ranks))]).cast("array<double>")
        block = F.size(F.filter(cuts, lambda c: c > F.col("pagerank"))).alias("block")  # block 0 has the greatest ranks
        words = [F.coalesce(index.terms(F.col(c)), F.array().cast("array<string>")).alias(c) for c in ("title", "content")]
        split = documents.select("link_id", "pagerank", block, *words)
        docs = split.select("link_id", (F.size("title") + F.size("content")).cast("long").alias("total"), "block", "pagerank", F.array_distinct(F.concat("title", "content")).alias("terms"), F.lit(True).alias("alive"))
        if deleted is not None:
            empty = F.array().cast("array<string>")
            docs = docs.unionByName(deleted.select("link_id", F.lit(0).cast("long").alias("total"), F.lit(-1).alias("block"), F.lit(None).cast("double").alias("pagerank"), empty.alias("terms"), F.lit(False).alias("alive")))
        seen = Observation()
        docs.observe(seen, F.count(F.when(F.col("alive"), 1)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("rows")).write.option("compression", "zstd").parquet(f"{self.path}/{name}/docs")
        counted = dict(seen.get)
        sized = split.select(_packed(F.col("link_id")).alias("link_id"), "block", (F.size("title") + F.size("content")).cast("long").alias("total"), "title", "content")
        index.write_postings(index.by_bucket(sized), f"{self.path}/{name}/postings", "block")
        of_term = self._read(name, "postings", _STORED).where("of_document is not null")
        stats = of_term.groupBy("bucket", "term", "block").agg(F.count(F.lit(1)).alias("n_docs"), F.max("of_document").alias("most"), F.min("total").alias("shortest"))
        lost = self._alive(older).join(self._read(name, "docs", _DOCS).select("link_id"), "link_id", "left_semi") if older else None
        if lost is not None:
            gone = lost.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")).first()
            counted["n"], counted["total"] = counted["n"] - gone["n"], counted["total"] - gone["total"]
            off = lost.select(F.explode("terms").alias("term")).groupBy("term").agg((-F.count(F.lit(1))).alias("n_docs"))
            stats = stats.unionByName(off.select(index.bucket(F.col("term")).alias("bucket"), "term", F.lit(-1).alias("block"), "n_docs", F.lit(0).cast("long").alias("most"), F.lit(0).cast("long").alias("shortest")))
        stats.repartition("bucket").sortWithinPartitions("bucket", "term").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/{name}/stats")
        top = self._read(name, "docs", _DOCS).where("alive").groupBy("block").agg(F.max("pagerank").alias("rank")).collect()  # one row for each block
        return {"name": name, "n": counted["n"], "total": counted["total"], "rows": counted["rows"], "ranks": {str(r["block"]): r["rank"] for r in top}}

    def _alive(self, segments: list[dict]) -> DataFrame:
        """(link_id, total, block, pagerank, terms, alive, segment) of the documents of some segments, each in its last one."""
        found = None
        for i, s in reversed(list(enumerate(segments))):
            own = self._read(s["name"], "docs", _DOCS).withColumn("segment", F.lit(i))
            found = own if found is None else found.unionByName(own.join(found.select("link_id"), "link_id", "left_anti"))
        return found.where("alive")

    def _settled(self, segments: list[dict], version: int) -> list[dict]:
        """Segments, the newest ones merged where an older one is at most twice as large as all that follow it."""
        for i in range(len(segments) - 1):
            if segments[i]["rows"] <= 2 * sum(s["rows"] for s in segments[i + 1 :]):
                return segments[:i] + [self._merge(segments[i:], f"segment-{version}-{uuid.uuid4().hex[:8]}", i == 0)]
        return segments

    def _merge(self, segments: list[dict], name: str, first: bool) -> dict:
        """One segment out of some that follow one another; marks of deletion go with the first."""
        seen = Observation()
        last = self._alive(segments)
        docs = last.drop("segment")
        if not first:
            marks = reduce(DataFrame.unionByName, (self._read(s["name"], "docs", _DOCS).where("not alive") for s in segments)).dropDuplicates(["link_id"])
            docs = docs.unionByName(marks.join(last.select("link_id"), "link_id", "left_anti"))
        docs.observe(seen, F.count(F.lit(1)).alias("rows")).write.option("compression", "zstd").parquet(f"{self.path}/{name}/docs")
        index.write_postings(self._live(segments, None).select(*(c for c in _columns(_STORED) if c != "bucket")), f"{self.path}/{name}/postings", "block")
        every = reduce(DataFrame.unionByName, (self._read(s["name"], "stats", _STATS) for s in segments))
        # Numbers of documents add up, those taken off included; bounds hold for what is left.
        stats = every.groupBy("bucket", "term", "block").agg(F.sum("n_docs").alias("n_docs"), F.max("most").alias("most"), F.min("shortest").alias("shortest"))
        stats.repartition("bucket").sortWithinPartitions("bucket", "term").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/{name}/stats")
        ranks: dict[str, float] = {}
        for s in segments:
            for b, rank in s["ranks"].items():
                ranks[b] = max(rank, ranks.get(b, rank))
        return {"name": name, "n": sum(s["n"] for s in segments), "total": sum(s["total"] for s in segments), "rows": seen.get["rows"], "ranks": ranks}

    # Reading

    def _of_terms(self, segment: dict, table: str, schema: str, terms: list[str] | None) -> DataFrame:
        rows = self._read(segment["name"], table, schema)
        if terms is None:
            return rows
        found = self.spark.createDataFrame([(t,) for t in terms], "t string").select(index.bucket(F.col("t"))).collect() if terms else []
        return rows.where(F.col("bucket").isin(*(r[0] for r in found)) & F.col("term").isin(*terms))

    def _live(self, segments: list[dict], terms: list[str] | None, blocks: dict[int, list[int]] | None = None) -> DataFrame:
        """Postings of terms as they are written, of some blocks by the number of the segment, without those of documents that came again or were deleted."""
        parts = []
        for i, s in enumerate(segments):
            if blocks is not None and not blocks.get(i):
                continue
            own = self._of_terms(s, "postings", _STORED, terms)
            if blocks is not None:
                own = own.where(F.col("block").isin(*blocks[i]))
            if later := segments[i + 1 :]:
                own = own.join(reduce(DataFrame.unionByName, (self._read(x["name"], "docs", _DOCS).select(_packed(F.col("link_id")).alias("link_id")) for x in later)), "link_id", "left_anti")
            parts.append(own.select(*_columns(_STORED)))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], _STORED)

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """(term, link_id, field, positions, n, total, block, bucket) of some terms, or of all."""
        return _postings(self._live(self._notes()["segments"], terms))

    def set_ranks(self, ranks: DataFrame) -> None:
        """New ranks (link_id, pagerank); documents that are not named keep theirs. Neither postings nor texts are written again."""
        notes = self._notes()
        name = f"ranks-{notes['version'] + 1}-{uuid.uuid4().hex[:8]}"
        new = ranks.groupBy("link_id").agg(F.max("pagerank").alias("pagerank"))
        if notes["ranks"]:
            old = self.spark.read.schema("link_id string, pagerank double").parquet(f"{self.path}/{notes['ranks']}")
            new = new.unionByName(old.join(new.select("link_id"), "link_id", "left_anti"))
        new.write.parquet(f"{self.path}/{name}")
        notes = notes | {"ranks": name}
        tops = self._ranked(notes).groupBy("segment", "block").agg(F.max("pagerank").alias("rank")).collect()  # one row for each block
        segments = [s | {"ranks": {str(r["block"]): r["rank"] for r in tops if r["segment"] == i}} for i, s in enumerate(notes["segments"])]
        self._commit(notes | {"segments": segments})

    def _ranked(self, notes: dict) -> DataFrame:
        """(link_id, pagerank, segment, block) of all documents."""
        docs = self._alive(notes["segments"]).select("link_id", "pagerank", "segment", "block")
        if not notes["ranks"]:
            return docs
        new = self.spark.read.schema("link_id string, pagerank double").parquet(f"{self.path}/{notes['ranks']}").withColumnRenamed("pagerank", "rank")
        return docs.join(new, "link_id", "left").select("link_id", F.coalesce("rank", "pagerank").alias("pagerank"), "segment", "block")

    def page(self, expression: str, offset: int = 0, size: int = 10, kind: str | None = None, operator: str = "or", order: str = "rank", score: str = "share") -> Page:
        """A page of hits (link_id, pagerank, score) in order, and how many postings it took.

        order: "rank" (greatest rank, then score), "sum" of both or "score"; score:
        "share" (of a document's terms) or "bm25". Ties go to the smaller id. For pages
        far behind, number all hits instead (`search.numbered`).
        """
        from webloom.functions.text import parse_query

        if kind is None:
            kind, expression = parse_query(expression)
        words = ordered_tokens(expression)
        terms, need = list(dict.fromkeys(words)), offset + size
        notes = self._notes()
        segments = notes["segments"]
        if not terms or not segments:
            return Page([], 0, 0)
        stats = [(i, r) for i, s in enumerate(segments) for r in self._of_terms(s, "stats", _STATS, terms).collect()]  # a row for each term and block
        n, total = sum(s["n"] for s in segments), sum(s["total"] for s in segments)
        with_term = {t: sum(r["n_docs"] for _, r in stats if r["term"] == t) for t in terms}
        average = total / n if n else 1.0
        weight = {t: math.log(1 + (n - d + 0.5) / (d + 0.5)) if n else 0.0 for t, d in with_term.items()}
        best: dict[tuple[int, int], list] = {}
        for i, r in stats:
            if r["block"] < 0:
                continue
            bound = best.setdefault((i, r["block"]), [0.0, 0, 0])
            if score == "bm25":
                bound[0] += weight[r["term"]] * r["most"] * (K1 + 1) / (r["most"] + K1 * (1 - B + B * r["shortest"] / average))
            else:
                bound[0] = min(1.0, bound[0] + r["most"] / max(1, r["shortest"]))
            bound[1] = max(bound[1], r["n_docs"])
            bound[2] += r["n_docs"]
        rank_of = lambda key: segments[key[0]]["ranks"].get(str(key[1]), float("-inf"))
        most = {"rank": rank_of, "sum": lambda k: rank_of(k) + best[k][0], "score": lambda k: best[k][0]}[order]
        left, read, hits, postings = sorted(best, key=lambda k: (-most(k), k)), [], [], 0
        while left:
            # Enough blocks for the page at first; then those that can still reach it.
            if len(hits) < need:
                expected, now = len(hits), []
                while left and (expected < need or not now):
                    expected += best[left[0]][1]
                    now.append(left.pop(0))
                if read:  # fewer hits than expected: twice as many blocks at least
                    now += [left.pop(0) for _ in range(min(len(left), len(read)))]
            else:
                least = hits[need - 1]
                reached = {"rank": least[1], "sum": least[1] + least[2], "score": least[2]}[order]
                left = [k for k in left if most(k) >= reached - 1e-9]
                if not left:
                    break
                now, left = left[: len(read)], left[len(read) :]  # as many again as were read, then the stop is tried anew
            read += now
            postings += sum(best[k][2] for k in now)
            found = self._scored(notes, terms, words, now, kind, operator, score, weight, average)
            hits = _first(hits + [tuple(r) for r in found.orderBy(*_order(order)).limit(need).collect()], order, need)  # a page's rows
        return Page(hits[offset:need], postings, sum(v[2] for v in best.values()))

    def _scored(self, notes: dict, terms: list[str], words: list[str], keys: list, kind: str, operator: str, score: str, weight: dict, average: float) -> DataFrame:
        """(link_id, pagerank, score) of the hits in some blocks."""
        segments, blocks = notes["segments"], {}
        for i, b in keys:
            blocks.setdefault(i, []).append(b)
        own = _postings(self._live(segments, terms, blocks))
        each = own.groupBy("link_id", "term").agg(F.sum("n").alias("n"), F.max("total").alias("total"))
        by_term = F.lit(0.0)
        for t in terms:
            by_term = F.when(F.col("term") == t, F.lit(weight[t])).otherwise(by_term)
        value = by_term * F.col("n") * (K1 + 1) / (F.col("n") + K1 * (1 - B + B * F.col("total") / average)) if score == "bm25" else F.col("n") / F.greatest("total", F.lit(1))
        hits = each.groupBy("link_id").agg(F.sum(value).alias("score"), F.count(F.lit(1)).alias("terms"))
        if kind == "phrase":
            hits = hits.join(phrase_hits(own, words), "link_id", "left_semi")
        elif operator == "and":
            hits = hits.where(F.col("terms") == len(terms))
        return hits.join(self._ranked(notes).select("link_id", "pagerank"), "link_id").select("link_id", F.coalesce("pagerank", F.lit(0.0)).alias("pagerank"), "score")


def _postings(stored: DataFrame) -> DataFrame:
    return stored.withColumn("link_id", _unpacked(F.col("link_id"))).select(*_columns(_POSTINGS))


def _columns(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _order(order: str) -> list[Column]:
    rank, score = F.col("pagerank"), F.col("score")
    return {"rank": [rank.desc(), score.desc()], "sum": [(rank + score).desc()], "score": [score.desc()]}[order] + [F.col("link_id").asc()]


def _first(hits: list[tuple], order: str, need: int) -> list[tuple]:
    key = {"rank": lambda h: (-h[1], -h[2], h[0]), "sum": lambda h: (-(h[1] + h[2]), h[0]), "score": lambda h: (-h[2], h[0])}[order]
    return sorted(hits, key=key)[:need]
