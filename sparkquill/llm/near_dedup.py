"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star-shaped edges.

A document's set is its distinct 5-word shingles. Equal sets are one node. One hash of each shingle falls
into one of rows x BANDS bins; a bin keeps its smallest hash, and an empty bin borrows from bins that a
universal hash names for it, so that two sets agree in a bin as likely as they overlap. BANDS groups of
rows bins make buckets; the rows follow from ``percent``, so that at just this similarity two sets miss all
buckets less than once in millions.

Pairs within a bucket are not listed. Each node is compared with one centre, the member of its buckets that
meets the most others; links are confirmed on the full sets and connected. Where a bucket then still holds several
components, its nodes go on with exact candidates. Of two sets that are similar enough, the rarest shingles (as many
as may be missing, and one) have one in common, so each of these shingles that several such nodes have is a smaller
bucket, and a node whose rarest shingles nobody shares is done. In such a bucket, members outside its largest component
meet the others, and of these pairs only those are measured that could still link: a pair differs by all shingles that
no other open node has at least, and if both were compared with one centre, by what the two distances from it and the
unique shingles leave (``feasible``). A bucket of many nodes is first cut into parts of like sizes and shares of unique
shingles; parts that these bounds hold apart never meet, the others meet two by two, each two under their own key, so no
task has more than PART x PART pairs of one key to look at. A pair is thus left out only if it is connected already or
proven too unlike.

Defined results: null or empty texts, or without words, have an empty set, link with nothing and are kept;
so are rows with a null doc_id (component null); texts under five words are one shingle; rows that repeat a
doc_id are told apart by their texts, and each row follows its own text's links; an empty table gives an empty
result; further columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import materialize, text_key

SHINGLE, BANDS = 5, 32
#: The share of pairs of just the asked similarity that all bands may miss.
MOST_MISSED = 3e-7
#: A pair is linked from this similarity on, in percent.
PERCENT = 80
#: Leaves of one centre that a task compares; a centre with more is dealt over several.
LEAVES = 256
#: Nodes of a rare shingle that are compared with each other in one go; more are cut into parts.
PART = 256
_ATTEMPTS = 2048


def band_rows(percent: int) -> int:
    """The most bins of a band that keep the share of missed pairs under MOST_MISSED: 6 at 85, 4 at 80."""
    rows = 1
    while rows < 16 and (1 - (percent / 100) ** (rows + 1)) ** BANDS <= MOST_MISSED:
        rows += 1
    return rows


def least_shingles(percent: int) -> int:
    """Sets with fewer shingles are similar enough only if they are equal: 6 at 85, 4 at 80."""
    return -(-percent // max(100 - percent, 1))


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the text and shingle hash, sorted by both, each once."""
    w = W.split(texts, lower=True)
    at = np.flatnonzero(w.whole(SHINGLE))
    doc, hashes = w.doc[at], w.rolling(SHINGLE)[at]
    sizes = np.diff(w.bounds)
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    if len(short):
        lone = [W.mix(np.bitwise_xor.reduce(W.mix(w.hash[w.bounds[d] : w.bounds[d + 1]] + np.arange(1, sizes[d] + 1, dtype=np.uint64)), keepdims=True))[0] for d in short.tolist()]
        doc, hashes = np.concatenate((doc, short)), np.concatenate((hashes, np.array(lone, np.uint64)))
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[new], hashes[new]


def signatures(doc: np.ndarray, hashes: np.ndarray, n: int, bins: int) -> np.ndarray:
    """One-permutation MinHash of n sets, densified; rows of empty sets mean nothing."""
    bin_ = ((hashes >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    # hashes are sorted within a set and bins rise with them: the first in a bin is its minimum
    cell, first = np.unique(doc * bins + bin_.astype(np.int64), return_index=True)
    out, full = np.zeros(n * bins, np.uint64), np.zeros(n * bins, bool)
    out[cell], full[cell] = hashes[first], True
    out, full = out.reshape(n, bins), full.reshape(n, bins)
    row, col = np.nonzero(~full & full.any(axis=1)[:, None])
    for attempt in range(_ATTEMPTS):
        if not len(row):
            break
        lender = (W.mix(col.astype(np.uint64) * np.uint64(_ATTEMPTS) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        lends = full[row, lender]
        out[row[lends], col[lends]] = out[row[lends], lender[lends]]
        row, col = row[~lends], col[~lends]
    if len(row):
        out[row, col] = out[row, full[row].argmax(axis=1)]
    return out


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    n, bins = signature.shape
    key = np.arange(bins // rows, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for r in range(rows):
        key = W.mix(key ^ signature[:, r::rows])
    return key


def _signature_rows(percent: int):
    rows, least = band_rows(percent), least_shingles(percent)

    def signature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in W.slices(batch):
                n = len(texts)
                doc, hashes = shingle_sets(texts)
                sizes = np.bincount(doc, minlength=n)
                digest = np.zeros((2, n), np.uint64)
                for i, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
                    np.add.at(digest[i], doc, W.mix(hashes ^ np.uint64(salt)))
                keys = bands(signatures(doc, hashes, n, rows * BANDS), rows)
                banded = sizes >= least
                offsets = np.concatenate(([0], np.cumsum(banded * BANDS)))
                yield pa.record_batch(
                    [
                        part.column("node"),
                        pa.array(sizes.astype(np.int64)),
                        pa.array(W.signed(digest[0])),
                        pa.array(W.signed(digest[1])),
                        W.lists(W.signed(keys[banded].ravel()), offsets, pa.int64()),
                    ],
                    ["node", "n_shingles", "set_a", "set_b", "bands"],
                )

    return signature_rows


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in W.slices(batch):
            doc, hashes = shingle_sets(texts)
            offsets = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(texts)))))
            yield pa.record_batch([part.column("node"), W.lists(W.signed(hashes), offsets, pa.int64())], ["node", "shingles"])


def measured(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, n_a, n_b, common: the edges with the sizes of their full sets and of what they share.

    ``a`` are centres: one of very many leaves stands in several tasks, each with a part of its leaves.
    """
    salts = edges.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / LEAVES).cast("int").alias("salts"))
    dealt = edges.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    centres = salts.select(F.col("a").alias("node"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    of_a = sets.join(centres, "node").select(F.col("node").alias("a"), "salt", F.col("shingles").alias("of_a"))
    of_b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    rows = dealt.join(of_b.hint("merge"), "b").join(of_a.hint("merge"), ["a", "salt"])
    return rows.select("a", "b", F.size("of_a").alias("n_a"), F.size("of_b").alias("n_b"), F.size(F.array_intersect("of_a", "of_b")).alias("common"))


def linked(percent: int) -> F.Column:
    return 100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of ``links`` (a, b).

    Labels of neighbours and then labels of labels are taken until nothing changes; the rounds grow with
    the logarithm of a component's diameter. Each round is written to the shared folder.
    """
    links = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    labels = materialize(labels, "labels")
    while True:
        of = labels.select(F.col("node").alias("b"), F.col("component").alias("c"))
        near = links.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "c").alias("component"))
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("beyond"))
        new = materialize(lower.join(jump, "component", "left").select("node", "old", F.least("component", F.coalesce("beyond", "component")).alias("component")), "labels")
        if not new.where("old <> component").limit(1).count():
            return new.select("node", "component")
        labels = new.select("node", "component")


def _relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components after ``links`` (between nodes) are added to components so far."""
    of = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    lifted = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    top = components(lifted.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct())
    up = top.select(F.col("node").alias("component"), F.col("component").alias("top"))
    moved = labels.join(up, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    fresh = top.join(labels.select("node"), "node", "left_anti").select("node", "component")
    return materialize(moved.unionByName(fresh), "labels")


def feasible(percent: int) -> F.Column:
    """Whether two open nodes (columns n, u, centre, d and o_n, o_u, o_centre, o_d) may be similar enough.

    Their sets share at most the smaller number of shingles that aren't unique (u are), and differ in both
    nodes' unique ones. With d elements between a node and its centre, two nodes of one centre differ in
    d + o_d less twice the elements that both differences hold, which are at most d - u and o_d - o_u.
    """
    n, u, d, o_n, o_u, o_d = (F.col(c) for c in ("n", "u", "d", "o_n", "o_u", "o_d"))
    shared = F.least(n - u, o_n - o_u)
    apart = F.when(F.col("centre") == F.col("o_centre"), d + o_d - 2 * F.least(d - u, o_d - o_u)).otherwise(0)
    return (
        (100 * F.least(n, o_n) >= percent * F.greatest(n, o_n))
        & ((100 - percent) * shared >= percent * (u + o_u))
        & ((100 + percent) * F.coalesce(apart, F.lit(0)) <= (100 - percent) * (n + o_n))
    )


def _rare_buckets(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """bucket, node, n, u, shorter: ``nodes`` by those of their rarest shingles that several of them have.

    In any order that all sets follow, two sets that are similar enough have a shingle in common among the first
    n - ceil(n * percent / 100) + 1 of the one with more, and the first n - ceil(n * 2 * percent / (100 + percent)) + 1
    of the other (``shorter``: the shingle is among these too). u shingles are the node's alone.
    """
    held = materialize(sets.join(nodes.hint("merge"), "node", "left_semi").select("node", F.explode("shingles").alias("h")), "held")
    counts = held.groupBy("h").agg(F.count(F.lit(1)).alias("f"))
    ordered = held.join(counts.hint("merge"), "h").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("f", "h"))).alias("fs"))
    n = F.size("fs")
    first = lambda part, of: (n - F.floor((n * part + (of - 1)) / of) + 1).cast("int")  # noqa: E731  (whole numbers: no share is rounded)
    unique = F.size(F.filter("fs", lambda x: x["f"] == 1)).alias("u")
    rarest = ordered.select("node", n.alias("n"), unique, first(2 * percent, 100 + percent).alias("short"), F.posexplode(F.slice("fs", F.lit(1), first(percent, 100))).alias("at", "x"))
    return rarest.where("x.f > 1").select(F.col("x.h").alias("bucket"), "node", "n", "u", (F.col("at") < F.col("short")).alias("shorter"))


def _unlike_sizes(percent: int, n: F.Column, shared: F.Column, u: F.Column, o_n: F.Column, o_shared: F.Column, o_u: F.Column, lo_n: F.Column, o_lo_n: F.Column) -> F.Column:
    """Whether no node of one part can be linked with one of another: sets of lo_n to n, at most ``shared`` and at least ``u`` shingles (un)shared."""
    far_sizes = 100 * F.least(n, o_n) < percent * F.greatest(lo_n, o_lo_n)
    return far_sizes | ((100 - percent) * F.least(shared, o_shared) < percent * (u + o_u))


def _parts_met(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` of large buckets with their ``part``, and bucket, a_part, b_part: the parts whose nodes may be linked.

    A part holds nodes of one bucket that are close in size and in their share of unique shingles, apart from those of the
    bucket's largest component, and about PART at most: a class of more is dealt over several by a hash of the node.
    Classes only make parts alike; what decides are the least and greatest values that a part really holds. Their number
    follows from the logarithm of the sizes, not from the rows, and a class meets only its neighbours.
    """
    # A node with so many shingles of its own is unlike every set.
    rows = rows.where((100 - percent) * (F.col("n") - F.col("u")) >= percent * F.col("u"))
    # A class is a little wider than the sizes that one set may be linked with, so those lie in its own or a neighbouring class.
    step = 1.0001 * float(np.log(100 / percent)) if percent < 100 else 1.0
    rows = rows.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / F.lit(step))).withColumn("share", F.floor(100 * F.col("u") / F.col("n")))
    rows = rows.withColumn("inner", F.col("component") == F.col("top"))
    cell = ["bucket", "inner", "class", "share"]
    sizes = rows.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("salts"))
    rows = rows.join(sizes.hint("merge"), cell).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")).drop("salts")
    rows = materialize(rows.withColumn("part", F.struct("inner", "class", "share", "salt")).drop("inner", "class", "share", "salt"), "parts")
    held = rows.groupBy("bucket", "part").agg(F.max("n").alias("n"), F.max(F.col("n") - F.col("u")).alias("shared"), F.min("u").alias("u"), F.min("n").alias("lo_n"))
    held = materialize(held, "held-parts")
    near = held.withColumn("near", F.explode(F.array(*[F.col("part.class") + k for k in (-1, 0, 1)])))
    other = held.select("bucket", F.col("part.class").alias("near"), *[F.col(c).alias(f"o_{c}") for c in ("part", "n", "shared", "u", "lo_n")])
    once = F.col("o_part.inner") | (F.col("part") <= F.col("o_part"))
    unlike = _unlike_sizes(percent, *(F.col(c) for c in ("n", "shared", "u", "o_n", "o_shared", "o_u", "lo_n", "o_lo_n")))
    met = near.where("not part.inner").join(other.hint("merge"), ["bucket", "near"]).where(once & ~unlike)
    return rows, met.select("bucket", F.col("part").alias("a_part"), F.col("o_part").alias("b_part"))


def _further_pairs(nodes: DataFrame, sets: DataFrame, labels: DataFrame, stars: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of open nodes in different components that may be similar enough; of ``stars``, how far a node is from its centre.

    A bucket of at most PART nodes is joined with itself. A larger one is cut into parts of about PART, and only parts whose
    sizes and unique shingles leave a link possible meet, each two of them under a key of their own.
    """
    far = stars.select(F.col("b").alias("node"), F.col("a").alias("centre"), (F.col("n_a") + F.col("n_b") - 2 * F.col("common")).alias("d"))
    known = nodes.join(labels.hint("merge"), "node", "left").join(far.hint("merge"), "node", "left")
    known = known.select("node", F.coalesce("component", "node").alias("component"), "centre", "d")
    rows = materialize(_rare_buckets(nodes, sets, percent).join(known.hint("merge"), "node"), "rare")
    parts = rows.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("size"))
    # Of each bucket with several components, the largest: its members need not meet each other.
    largest = parts.groupBy("bucket").agg(F.max(F.struct("size", "component")).alias("top"), F.count(F.lit(1)).alias("parts"), F.sum("size").alias("members")).where("parts > 1")
    rows = materialize(rows.join(largest.select("bucket", "members", F.col("top.component").alias("top")).hint("merge"), "bucket"), "rare")

    columns = ("node", "n", "u", "shorter", "centre", "d", "component")
    of = lambda x, *key: x.select(*key, *[F.col(c).alias(f"o_{c}") for c in columns])
    less = F.struct("n", "node") < F.struct(F.col("o_n").alias("n"), F.col("o_node").alias("node"))
    may = (F.col("component") != F.col("o_component")) & F.when(less, F.col("shorter")).otherwise(F.col("o_shorter")) & feasible(percent)
    ends = F.col("node").alias("a"), F.col("o_node").alias("b")

    small = rows.where(F.col("members") <= PART)
    met = (F.col("o_component") == F.col("top")) | (F.col("node") < F.col("o_node"))
    pairs = small.where("component <> top").join(of(small, "bucket").hint("merge"), "bucket").where(met & may).select(*ends)
    large = rows.where(F.col("members") > PART)
    if _some(large):
        large, meeting = _parts_met(large, percent)
        meeting = materialize(meeting, "meeting")
        key = ["bucket", "a_part", "b_part"]
        left = large.withColumnRenamed("part", "a_part").join(meeting.hint("merge"), ["bucket", "a_part"])
        right = of(large.withColumnRenamed("part", "b_part").join(meeting.hint("merge"), ["bucket", "b_part"]), *key)
        met = (F.col("a_part") != F.col("b_part")) | (F.col("node") < F.col("o_node"))
        pairs = pairs.unionByName(left.join(right.hint("merge"), key).where(met & may).select(*ends))
    return materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")


def _open(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` of buckets that hold several components, with their ``component``."""
    placed = rows.join(labels.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    return placed.join(mixed.hint("merge"), "bucket")


def _some(rows: DataFrame) -> bool:
    return rows.limit(1).count() > 0


def near_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, key, n_shingles, component_id, first (whether no smaller row is linked) for rows with a doc_id."""
    node = F.struct("doc_id", text_key().alias("key")).alias("node")
    rows = docs.where("doc_id is not null").select(node, "text")
    rows = materialize(rows.mapInArrow(_signature_rows(percent), "node struct<doc_id:long,key:long>, n_shingles long, set_a long, set_b long, bands array<long>"), "signatures")
    alike = ["n_shingles", "set_a", "set_b"]
    nodes = rows.where("n_shingles > 0").groupBy(*alike).agg(F.min("node").alias("node"), F.first("bands").alias("bands"))
    nodes = materialize(nodes, "nodes")

    in_bucket = nodes.select("node", F.explode("bands").alias("bucket"))
    sizes = in_bucket.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = materialize(in_bucket.join(sizes.hint("merge"), "bucket"), "members")
    meets = members.groupBy("node").agg((-F.sum("size")).alias("order"))  # the smallest meets the most
    members = materialize(members.join(meets, "node").select("bucket", "node", "order"), "members")
    wanted = members.select(F.col("node.doc_id").alias("doc_id"), F.col("node.key").alias("key")).distinct()
    sets = docs.select("doc_id", text_key().alias("key"), "text").join(wanted.hint("merge"), ["doc_id", "key"], "left_semi").dropDuplicates(["doc_id", "key"])
    sets = materialize(sets.select(F.struct("doc_id", "key").alias("node"), "text").mapInArrow(_set_rows, "node struct<doc_id:long,key:long>, shingles array<long>"), "sets")

    stars = members.groupBy("bucket").agg(F.min(F.struct("order", "node")).alias("centre"))
    edges = members.join(stars.hint("merge"), "bucket").where(F.col("node") != F.col("centre.node"))
    edges = edges.groupBy(F.col("node").alias("b")).agg(F.min("centre").alias("centre")).select(F.col("centre.node").alias("a"), "b")
    first = materialize(measured(edges, sets), "stars")
    labels = components(first.where(linked(percent)))

    open_ = materialize(_open(members.select("bucket", "node"), labels).select("node").distinct(), "open")
    if _some(open_):
        pairs = _further_pairs(open_, sets, labels, first, percent)
        links = materialize(measured(pairs, sets).where(linked(percent)).select("a", "b"), "links")
        if _some(links):
            labels = _relabel(labels, links)

    of_rows = rows.select("node", *alike).withColumnRenamed("node", "row")
    of_rows = of_rows.join(nodes.select(*alike, "node").hint("merge"), alike, "left").join(labels.hint("merge"), "node", "left")
    top = F.coalesce("component", "node", "row")
    return of_rows.select("row.doc_id", "row.key", "n_shingles", top["doc_id"].alias("component_id"), (F.col("row") == top).alias("first"))


def near_dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, key (tells texts of one doc_id apart), n_shingles, component_id, kept, first.

    ``kept``: doc_id = component_id. ``first``: the row's own text is its component's first, which differs from
    ``kept`` only where a doc_id repeats with texts that are linked.
    """
    placed = near_components(docs, percent).withColumn("kept", F.col("doc_id") == F.col("component_id"))
    unknown = docs.where("doc_id is null").select("doc_id", text_key().alias("key"), F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("first"), F.lit(True).alias("kept"))
    return placed.unionByName(unknown)


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""
