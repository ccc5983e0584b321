"""Line dedup over levelled sorted runs of line hashes, in DataFrame functions only.

A line's key is the line without white space at its ends, A-Z lower-cased; keys of at least LEAST characters count. The
index holds each key once, as 96 bits of hash with the number of documents and the largest doc_id of the batch that
brought it. A batch is reduced to its own keys (combined in the scanning tasks, so a line that all documents hold is one
row a task), which merge-anti-join the runs: what no run holds becomes a run of level 0, what some run holds goes to a
short list of repeats. So runs share no key, and FANOUT runs of one level merge into one of the next by an outer merge
join. Runs are bucketed by key and sorted in their buckets: neither the joins of a batch nor the merges shuffle history.
A manifest names runs and repeats, and an index is opened again from it; a batch that fails before its manifest is
written leaves the index as it was. Buckets are as many as the session that began an index has shuffle partitions, or as given.

Keys of COPIES documents or more are looked up for the lines of the documents asked for; these lose the lines of such
a key unless they are its largest doc_id. A call on an index with earlier runs counts their documents too; results of
earlier calls are not revised, and a document that was taken in before must not be taken in again.

Defined results: a null text is an empty one and has one empty line; each row counts as a document, rows that repeat a
doc_id too, and those of the largest doc_id all keep their lines; a null doc_id is smaller than any other, and where
all rows of a key have none, all keep it; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import json
import string
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, files_in, materialize, new_folder, remove_folder, shuffles_dropped, text_key

SPACE = " \t\n\x0b\x0c\r"
#: Characters of a key that counts, documents that make it frequent.
LEAST, COPIES = 20, 3
#: Runs of one level that are merged into one of the next.
FANOUT = 4
#: Frequent keys up to which their table is broadcast (some 30 bytes each); beyond, lines are shuffled to meet it.
MOST_FREQUENT = 1_000_000
KEY = ["h", "c"]
_SORTED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), string.ascii_uppercase, string.ascii_lowercase)


def _hashed(key: str) -> tuple[Column, Column]:
    return F.xxhash64(key).alias("h"), F.hash(key).alias("c")


def keys(docs: DataFrame) -> DataFrame:
    """h, c, n (documents), last (largest doc_id): each key of ``docs`` once."""
    held = F.array_distinct(F.filter(F.transform(_lines(F.col("text")), _key), lambda k: F.length(k) >= LEAST))
    rows = docs.select("doc_id", F.explode_outer(held).alias("key")).where("key is not null").select("doc_id", *_hashed("key"))
    return rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))


class LineIndex:
    """Levelled runs of line keys under one folder of the shared file system."""

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.folder = folder or new_folder(spark, "lines")
        self.runs: list[dict] = []
        self.repeats: list[str] = []
        self.version = 0
        known = [name for name in files_in(spark, self.folder) if name.startswith("manifest-")]
        if known:
            latest = max(known, key=lambda name: int(name.split("-")[1]))
            self.version = int(latest.split("-")[1])
            held = json.loads(spark.read.text(f"{self.folder}/{latest}", wholetext=True).first().value)
            self.runs, self.repeats, buckets = held["runs"], held["repeats"], held["buckets"]
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _commit(self, runs: list[dict], repeats: list[str]) -> None:
        """A new manifest: Spark's writer makes it whole or not at all, and readers take the last one; then what it leaves out goes."""
        self.version += 1
        text = json.dumps({"runs": runs, "repeats": repeats, "buckets": self.buckets})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{self.folder}/manifest-{self.version}")
        kept = {run["name"] for run in runs} | set(repeats)
        gone = ({run["name"] for run in self.runs} | set(self.repeats)) - kept
        self.runs, self.repeats = runs, repeats
        for name in gone:
            remove_folder(self.spark, f"{self.folder}/{name}")

    @contextmanager
    def _bucketed(self):
        """Gives ``table(name)`` and ``save(rows, name)`` for folders of the index as bucketed tables, which stay in the catalogue only meanwhile."""
        tables: dict[str, str] = {}
        before = self.spark.conf.get(_SORTED)
        self.spark.conf.set(_SORTED, "true")  # a bucket is one file, read as sorted as it was written

        def table(name: str) -> DataFrame:
            if name not in tables:
                tables[name] = f"lines_{uuid.uuid4().hex}"
                self.spark.sql(
                    f"CREATE TABLE {tables[name]} (h BIGINT, c INT, n BIGINT, last BIGINT) USING parquet "
                    f"CLUSTERED BY (h, c) SORTED BY (h, c) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'"
                )
            return self.spark.table(tables[name])

        def save(rows: DataFrame, name: str) -> DataFrame:
            tables[name] = f"lines_{uuid.uuid4().hex}"
            writer = rows.select(*KEY, "n", "last").write.option("compression", "zstd").bucketBy(self.buckets, *KEY).sortBy(*KEY)
            with shuffles_dropped(self.spark):
                writer.option("path", f"{self.folder}/{name}").saveAsTable(tables[name])
            return self.spark.table(tables[name])

        try:
            yield table, save
        finally:
            for name in tables.values():
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self.spark.conf.set(_SORTED, before)

    def append(self, docs: DataFrame) -> None:
        """Takes a batch in: its keys that no run holds become a run, the others go to the repeats; then full levels are merged."""
        batch, run, repeat = (f"{kind}-{uuid.uuid4().hex[:12]}" for kind in ("batch", "run", "repeats"))
        own = keys(docs)
        if int(self.spark.conf.get("spark.sql.shuffle.partitions")) != self.buckets:
            own = own.repartition(self.buckets, *KEY)
        with self._bucketed() as (table, save):
            if not self.runs:
                save(own, run)
                self._commit([{"name": run, "level": 0}], [])
                return
            own = fresh = save(own, batch)
            for old in self.runs:
                fresh = fresh.join(table(old["name"]).select(*KEY).hint("merge"), KEY, "left_anti")
            fresh = save(fresh, run)
            save(own.join(fresh.select(*KEY).hint("merge"), KEY, "left_anti"), repeat)
            self._commit([*self.runs, {"name": run, "level": 0}], [*self.repeats, repeat])
        remove_folder(self.spark, f"{self.folder}/{batch}")
        self.compact()

    def compact(self) -> None:
        """Merges ``fanout`` runs of one level into one of the next, as long as there are so many; and so many lists of repeats into one."""
        runs, repeats = self.runs, self.repeats
        full = lambda: next((x for x in sorted({r["level"] for r in runs}) if sum(r["level"] == x for r in runs) >= self.fanout), None)
        with self._bucketed() as (table, save):
            while (level := full()) is not None:
                old = [r for r in runs if r["level"] == level]
                name = f"run-{uuid.uuid4().hex[:12]}"
                merged = table(old[0]["name"])
                for run in old[1:]:  # runs share no key: an outer merge join interleaves them
                    more = table(run["name"]).toDF(*KEY, "more_n", "more_last").hint("merge")
                    merged = merged.join(more, KEY, "full_outer").select(*KEY, F.coalesce("n", "more_n").alias("n"), F.coalesce("last", "more_last").alias("last"))
                save(merged, name)
                runs = [*[r for r in runs if r["level"] != level], {"name": name, "level": level + 1}]
            if len(repeats) > self.fanout:
                name = f"repeats-{uuid.uuid4().hex[:12]}"
                save(self._repeated(table, repeats), name)
                repeats = [name]
            if runs is not self.runs or repeats is not self.repeats:
                self._commit(runs, repeats)

    def _repeated(self, table, repeats: list[str]) -> DataFrame:
        rows = None
        for name in repeats:
            rows = table(name) if rows is None else rows.unionByName(table(name))
        return rows.groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("last").alias("last"))

    def frequent(self, copies: int = COPIES) -> DataFrame:
        """h, c, last: keys of at least ``copies`` documents so far, and the largest doc_id of each."""
        found = None
        with self._bucketed() as (table, _):
            for run in self.runs:
                rows = table(run["name"])
                if self.repeats:
                    more = self._repeated(table, self.repeats).toDF(*KEY, "more_n", "more_last")
                    rows = rows.join(more, KEY, "left").select(*KEY, (F.col("n") + F.coalesce("more_n", F.lit(0))).alias("n"), F.greatest("last", "more_last").alias("last"))
                rows = rows.where(F.col("n") >= copies).select(*KEY, "last")
                found = rows if found is None else found.unionByName(rows)
            if found is None:
                return self.spark.createDataFrame([], "h long, c int, last long")
            return materialize(found, "frequent")


def dropped_lines(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """doc_id, key (tells rows of one doc_id apart), gone: the places of lines to drop, ascending."""
    # the text is hashed and its lines are keyed before they are exploded, so once each
    rows = docs.select("doc_id", text_key().alias("key"), F.transform(_lines(F.col("text")), _key).alias("lines"))
    # outer: else a condition on the array's size would be put below, and the array made twice
    lines = rows.select("doc_id", "key", F.posexplode_outer("lines").alias("at", "line")).where(F.length("line") >= LEAST)
    lines = lines.select("doc_id", "key", "at", *_hashed("line"))
    few = bounded(frequent, MOST_FREQUENT)
    met = lines.join(F.broadcast(frequent) if few else frequent, KEY).where(~F.col("doc_id").eqNullSafe(F.col("last")))
    return met.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("at")).alias("gone"))


def remove_lines(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_sha256."""
    gone = dropped.select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), "gone")
    rows = docs.select("doc_id", "text", text_key().alias("key"))
    rows = rows.join(gone, (rows.key == gone._key) & rows.doc_id.eqNullSafe(gone._doc), "left")
    rows = rows.select("doc_id", "text", "gone", _lines(F.col("text")).alias("lines"))
    # what stays are the stretches between dropped places
    starts = F.concat(F.array(F.lit(0)), F.transform("gone", lambda g: g + 1))
    ends = F.concat("gone", F.array(F.size("lines")))
    stretches = F.zip_with(starts, ends, lambda a, b: F.slice("lines", a + 1, b - a))
    kept = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.flatten(stretches), "\n"))
    return rows.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(kept.cast("binary"), 256).alias("kept_sha256"),
    )


def line_dedup(docs: DataFrame, batches: int = 2, index: LineIndex | None = None) -> DataFrame:
    """Takes ``docs`` into an index in ``batches`` of ascending doc_id, and drops the lines of frequent keys."""
    index = index or LineIndex(docs.sparkSession)
    cuts = ", ".join(str(i / batches) for i in range(1, batches))
    edges = docs.selectExpr(f"percentile_approx(doc_id, array({cuts}), 1000) e").first()["e"] if batches > 1 else []
    edges = [None, *sorted(set(edges or [])), None]
    for low, high in zip(edges, edges[1:]):
        batch = docs
        if low is not None:
            batch = batch.where(F.col("doc_id") > low)
        if high is not None:
            batch = batch.where((F.col("doc_id") <= high) | F.col("doc_id").isNull() if low is None else F.col("doc_id") <= high)
        index.append(batch)
    return remove_lines(docs, dropped_lines(docs, index.frequent()))


ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, last IS NOT NULL AND doc_id <> last AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
