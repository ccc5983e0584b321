"""Substring dedup over a log-structured index of window fingerprints.

A window is 13 words in a row. Its fingerprint is the smallest hash of its nine 5-word parts: equal windows
have equal fingerprints, and as neighbouring windows mostly share theirs, a text has about one for five
words. The index holds (fingerprint, doc_id) in immutable runs, each bucketed by fingerprint and sorted in its
buckets; a manifest names them, and an index is opened again from it. A new batch becomes a run of the same buckets and is
merge-joined with the earlier runs bucket by bucket, so history is read in order and never shuffled; documents
on both sides of a match are candidates. Before a batch comes in, runs that are too many are merged into one.
A fingerprint of more than HOT_ROWS rows in a batch has one row in the run that sums them up; its own rows lie beside,
in files of even size, and are read where the sum matches.

Candidates are verified: their texts are read again, the windows under matching fingerprints are hashed whole (96 bits
from two independent hashes of all 13 words), and a window is a repeat if a smaller doc_id has it too. The index holds
no texts: a call on an index with earlier runs takes the earlier documents as ``history``, of which only candidates are
read beyond their doc_id. Results of earlier calls are not revised.

Defined results: null or empty texts have no words and keep none (``kept_sha256`` is that of the empty
text); texts under 13 words are kept whole; rows with a null doc_id are kept whole and repeat nothing;
rows that share a doc_id don't remove from each other, since neither is smaller; an empty table gives an
empty result; further columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .common import bounded, files_in, materialize, new_folder, remove_folder, shuffles_dropped

WINDOW, PART = 13, 5
#: Rows of one fingerprint that one task takes; a fingerprint with more is dealt over several.
HOT_ROWS = 5_000
#: Hot fingerprints up to which their table is broadcast (32 bytes each).
MOST_HOT = 1_000_000
#: Runs that an index holds before they are merged into one.
MOST_RUNS = 4


def _fingerprints(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """For each window inside one text: its first word and its fingerprint."""
    inside = np.flatnonzero(w.whole(WINDOW))
    return inside, W.sliding_min(w.rolling(PART), WINDOW - PART + 1)[inside]


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in W.slices(batch):
            w = W.split(texts)
            first, prints = _fingerprints(w)
            doc = w.doc[first]
            # one row for each fingerprint of a document
            order = np.lexsort((prints, doc))
            doc, prints = doc[order], prints[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (prints[1:] != prints[:-1])
            take = pa.array(doc[new])
            yield pa.record_batch([pa.array(W.signed(prints[new])), part.column("doc_id").take(take)], ["fp", "doc_id"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """fp, doc_id: once for each document and fingerprint."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprint_rows, "fp long, doc_id long")


class FingerprintIndex:
    """Runs of fingerprints under one folder of the shared file system.

    A run is a bucketed table (fp, doc_id, n, last): plain rows have no n; a row with n sums up the n rows that a hot
    fingerprint has in one batch, from the smallest doc_id to ``last``; the rows themselves are in a folder of the run.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, most_runs: int = MOST_RUNS, hot_rows: int = HOT_ROWS):
        self.spark, self.most_runs, self.hot_rows = spark, most_runs, hot_rows
        self.folder = folder or new_folder(spark, "fingerprints")
        self.runs: list[dict] = []
        self.tables: dict[str, str] = {}
        self.version = 0
        known = [name for name in files_in(spark, self.folder) if name.startswith("manifest-")]
        if known:
            latest = max(known, key=lambda name: int(name.split("-")[1]))
            self.version = int(latest.split("-")[1])
            self.runs = json.loads(spark.read.text(f"{self.folder}/{latest}", wholetext=True).first().value)
        # one number of buckets for all runs of an index: that of the shuffles of the session that began it
        self.buckets = self.runs[0]["buckets"] if self.runs else int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _commit(self, runs: list[dict]) -> None:
        """A new manifest: Spark's writer makes it whole or not at all, and readers take the last one."""
        self.version += 1
        self.spark.createDataFrame([(json.dumps(runs),)], "value string").coalesce(1).write.text(f"{self.folder}/manifest-{self.version}")
        self.runs = runs

    def _table(self, run: dict) -> DataFrame:
        """A run's rows as a bucketed table, whose buckets join and group without a shuffle."""
        name = self.tables.get(run["name"])
        if name is None:
            name = self.tables[run["name"]] = f"fingerprints_{uuid.uuid4().hex}"
            path = f"{self.folder}/{run['name']}"
            self.spark.sql(f"CREATE TABLE {name} (fp BIGINT, doc_id BIGINT, n BIGINT, last BIGINT) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {run['buckets']} BUCKETS LOCATION '{path}'")
        return self.spark.table(name)

    def _hot(self, run: dict) -> DataFrame:
        return self.spark.read.schema("fp long, doc_id long").parquet(*[f"{self.folder}/{x}" for x in run["hot"]])

    def _save(self, rows: DataFrame, path: str) -> str:
        """``rows``, dealt by fp to one task a bucket and sorted, as a bucketed table; gives its name."""
        name = f"fingerprints_{uuid.uuid4().hex}"
        with shuffles_dropped(self.spark):
            rows.write.option("compression", "zstd").bucketBy(self.buckets, "fp").sortBy("fp").option("path", path).saveAsTable(name)
        return name

    def _write(self, rows: DataFrame, hot: list[str]) -> dict:
        """``rows`` (fp, doc_id, n, last) as a run; ``hot`` names the folders of its hot fingerprints."""
        run = {"name": f"run-{uuid.uuid4().hex[:12]}", "buckets": self.buckets, "hot": hot}
        dealt = rows.repartition(self.buckets, "fp").sortWithinPartitions("fp", "doc_id")
        self.tables[run["name"]] = self._save(dealt, f"{self.folder}/{run['name']}")
        return run

    def _take_in(self, docs: DataFrame) -> dict:
        scratch = new_folder(self.spark, "prints")
        rows = materialize(fingerprints(docs), "prints", f"{scratch}/rows")
        summed = F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last")
        sums = materialize(rows.groupBy("fp").agg(*summed).where(F.col("n") > self.hot_rows), "hot")
        nothing, folders = F.lit(None).cast("long"), []
        every = rows.select("fp", "doc_id", nothing.alias("n"), nothing.alias("last"))
        if not bounded(sums, 0):
            named = F.broadcast(sums.select("fp")) if bounded(sums, MOST_HOT) else sums.select("fp")
            folders = [f"hot-{uuid.uuid4().hex[:12]}"]
            rows.join(named, "fp", "left_semi").write.option("compression", "zstd").parquet(f"{self.folder}/{folders[0]}")
            every = every.join(named, "fp", "left_anti").unionByName(sums)
        run = self._write(every, folders)
        remove_folder(self.spark, scratch)
        return run

    def append(self, docs: DataFrame) -> DataFrame:
        """Adds a batch as a run; gives the candidates: doc_id, fp, n (rows of that fingerprint so far)."""
        self.compact()
        run = self._take_in(docs)
        runs = [*self.runs, run]
        # Each run by fingerprint: buckets are read as they lie, and meet those of the same number in the other runs.
        sums = lambda r: self._table(r).groupBy("fp").agg(
            F.sum(F.coalesce("n", F.lit(1))).alias("n"), F.min("doc_id").alias("first"), F.max(F.coalesce("last", "doc_id")).alias("last"), F.max("n").isNotNull().alias("hot")
        )
        of = sums(run)
        for number, old in enumerate(self.runs):
            of = of.join(sums(old).select("fp", *[F.col(c).alias(f"{c}_{number}") for c in ("n", "first", "last", "hot")]).hint("merge"), "fp", "left")
        every = lambda name: [name, *[f"{name}_{i}" for i in range(len(self.runs))]]
        total = sum((F.coalesce(c, F.lit(0)) for c in every("n")), F.lit(0))
        first, last = (F.least(*every("first")), F.greatest(*every("last"))) if self.runs else (F.col("first"), F.col("last"))
        hot = sum((F.coalesce(c, F.lit(False)).cast("int") for c in every("hot")), F.lit(0)) > 0
        scratch = new_folder(self.spark, "repeated")
        with self._sorted_buckets():
            repeated = self.spark.table(self._save(of.where(first < last).select("fp", total.alias("n"), hot.alias("hot")), f"{scratch}/rows"))
            found = [self._table(r).where("n is null").select("fp", "doc_id").join(repeated.select("fp", "n").hint("merge"), "fp") for r in runs]
            if any(r["hot"] for r in runs):
                matched = materialize(repeated.where("hot").select("fp", "n"), "hot")
                named = F.broadcast(matched) if bounded(matched, MOST_HOT) else matched
                found += [self._hot(r).join(named, "fp") for r in runs if r["hot"]]
            rows = found[0]
            for more in found[1:]:
                rows = rows.unionByName(more)
            candidates = materialize(rows.select("doc_id", "fp", "n"), "candidates")
        remove_folder(self.spark, scratch)
        self._commit(runs)
        return candidates

    @contextmanager
    def _sorted_buckets(self):
        """Within it, a bucket of one file is read as sorted as it was written."""
        name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
        before = self.spark.conf.get(name)
        self.spark.conf.set(name, "true")
        try:
            yield
        finally:
            self.spark.conf.set(name, before)

    def compact(self) -> None:
        """Merges the runs into one if they are more than ``most_runs``; folders of hot fingerprints stay as they are."""
        if len(self.runs) <= self.most_runs:
            return
        old = self.runs
        rows = self._table(old[0])
        for run in old[1:]:
            rows = rows.unionByName(self._table(run))
        self._commit([self._write(rows, [x for run in old for x in run["hot"]])])
        for run in old:
            self.spark.sql(f"DROP TABLE {self.tables.pop(run['name'])}")
            remove_folder(self.spark, f"{self.folder}/{run['name']}")


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, fps, salts -> the windows under the listed fingerprints; one of several salts is dealt by its document."""
    for batch in batches:
        for part, texts in W.slices(batch):
            w = W.split(texts)
            first, prints = _fingerprints(w)
            doc = w.doc[first]
            listed = part.column("fps")
            sizes = np.diff(listed.offsets.to_numpy())
            flat = listed.flatten()
            wanted = flat.to_numpy(zero_copy_only=False).view(np.uint64) if len(flat) else np.zeros(0, np.uint64)
            salts = part.column("salts").flatten().to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0, np.int32)
            # documents and their fingerprints as one sorted key, to look windows up at once
            key = W.mix(wanted ^ W.mix(np.repeat(np.arange(len(texts)), sizes).astype(np.uint64)))
            order = np.argsort(key)
            key, salts = key[order], salts[order]
            mine = W.mix(prints ^ W.mix(doc.astype(np.uint64)))
            at = np.minimum(np.searchsorted(key, mine), max(len(key) - 1, 0))
            hit = key[at] == mine if len(key) else np.zeros(len(mine), bool)
            first, doc, at = first[hit], doc[hit], at[hit]
            whole = w.rolling(WINDOW)[first]
            # one row for each window of a document, however often it stands there
            order = np.lexsort((whole, doc))
            new = np.ones(len(order), bool)
            new[1:] = (doc[order][1:] != doc[order][:-1]) | (whole[order][1:] != whole[order][:-1])
            order = order[new]
            first, doc, at, whole = first[order], doc[order], at[order], whole[order]
            check = w.rolling(WINDOW, second=True)[first]
            take = pa.array(doc)
            ids = part.column("doc_id").take(take)
            dealt = salts[at] if len(at) else np.zeros(0, np.int32)
            salt = np.where(dealt > 1, W.mix(ids.to_numpy().view(np.uint64)) % np.maximum(dealt, 1).astype(np.uint64), -1).astype(np.int32) if len(at) else dealt
            yield pa.record_batch(
                [
                    pa.array(W.signed(whole)),
                    pa.array((check >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                    ids,
                    pa.array(salt, pa.int32()),
                ],
                ["whole", "check", "doc_id", "salt"],
            )


def repeated_windows(docs: DataFrame, candidates: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, whole: windows (by hash) of a document that also start in a document with a smaller doc_id."""
    listed = candidates.groupBy("doc_id", "fp").agg(F.ceil(F.max("n") / hot_rows).cast("int").alias("salts"))
    listed = listed.groupBy("doc_id").agg(F.collect_list("fp").alias("fps"), F.collect_list("salts").alias("salts"))
    texts = docs.select("doc_id", "text").join(listed.hint("merge"), "doc_id")
    rows = texts.mapInArrow(_window_rows, "whole long, check int, doc_id long, salt int")
    # A window of a very frequent fingerprint is dealt over as many salts as its rows ask for: its smallest document
    # of each salt is found first, and these few are compared with each other in a second step.
    window = ["whole", "check", "salt"]
    least = F.min("doc_id").over(Window.partitionBy(*window).orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0))
    seen = rows.withColumn("least", least)
    later = F.col("doc_id") > F.col("least")
    across = F.min("doc_id").over(Window.partitionBy("whole", "check"))
    # One condition over both columns, so that it isn't moved below the first exchange, which both branches share.
    firsts = seen.where(F.when(later, -1).otherwise(F.col("salt")) >= 0).withColumn("least", across)
    return seen.where(later).unionByName(firsts.where(later)).select("doc_id", "whole")


def _kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in W.slices(batch):
            w = W.split(texts)
            counts, removed, digests = [], [], []
            whole = W.signed(w.rolling(WINDOW))
            for d, repeats in enumerate(part.column("repeats")):
                a, b = int(w.bounds[d]), int(w.bounds[d + 1])
                gone = np.zeros(b - a + 1, np.int32)
                if repeats.is_valid and b - a >= WINDOW:
                    first = np.flatnonzero(np.isin(whole[a : b - WINDOW + 1], repeats.values.to_numpy(zero_copy_only=False)))
                    gone[first] += 1
                    gone[first + WINDOW] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                stays = w.span(a, b)
                if gone.any():
                    stays = [x for x, g in zip(stays, gone.tolist()) if not g]
                counts.append(b - a)
                removed.append(b - a - len(stays))
                digests.append(hashlib.sha256(b" ".join(stays)).hexdigest())
            yield pa.record_batch(
                [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )


def remove_repeats(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    repeats = windows.groupBy("doc_id").agg(F.collect_set("whole").alias("repeats"))
    rows = docs.select("doc_id", "text").join(repeats.hint("merge"), "doc_id", "left")
    return rows.mapInArrow(_kept_rows, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def substring_dedup(docs: DataFrame, batches: int = 2, index: FingerprintIndex | None = None, history: DataFrame | None = None) -> DataFrame:
    """Takes ``docs`` into an index in ``batches`` of ascending doc_id, and removes repeated windows.

    ``history`` (doc_id, text) holds all documents that the index took in before; it gives no rows of its own.
    """
    spark = docs.sparkSession
    index = index or FingerprintIndex(spark)
    if index.runs and history is None:
        raise ValueError("an index with earlier runs needs the texts of their documents as history")
    known = docs.where("doc_id is not null")
    edges = known.selectExpr(f"percentile_approx(doc_id, array({', '.join(str(i / batches) for i in range(1, batches))}), 1000) e").first()["e"] if batches > 1 else []
    edges = [None, *sorted(set(edges or [])), None]
    candidates = None
    for low, high in zip(edges, edges[1:]):
        batch = known
        batch = batch if low is None else batch.where(F.col("doc_id") > low)
        batch = batch if high is None else batch.where(F.col("doc_id") <= high)
        found = index.append(batch)
        candidates = found if candidates is None else candidates.unionByName(found)
    texts = known if history is None else known.select("doc_id", "text").unionByName(history.where("doc_id is not null").select("doc_id", "text"))
    windows = materialize(repeated_windows(texts, candidates), "windows")
    return remove_repeats(docs, windows)


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM s),
m AS (SELECT doc_id, i, doc_id > min(doc_id) OVER (PARTITION BY g) AS later FROM g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM m WHERE later),
k AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id),
r AS (SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN k USING (doc_id)),
o AS (SELECT doc_id, w, gone, list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)) AS stay FROM r)
SELECT doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
       sha256(array_to_string(list_transform(stay, lambda i: w[i]), ' ')) AS kept_sha256 FROM o
"""
