"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Equal texts are a group and stay together, unless a group is more than half a shard in any size; then its rows
are dealt to pieces by their place in it, since whole groups of that size would leave shards unlike. Groups over 1/(64 x shards) of the corpus in
any of the three sizes are items of their own (there are at most 3 x 64 x shards of them); all others are
bundled by a hash of their text into 256 bundles a shard. The driver thus packs a bounded number of items:
largest first, each where the dot product of its sizes with the shard's residual capacity is highest, and
then moves items from the fullest to the emptiest shard while that levels their bytes.

Law: ``bytes``. Defined results: null texts count as empty ones (8 bytes); rows that repeat take slots of
their own; a null doc_id is placed like any other; an empty table gives an empty result; further columns of
the input are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, numbered

SHARDS, OWN, BUNDLES, PIECE = 24, 64, 256, 16
WORD = "[^\\x20\\x09-\\x0D]+"


def place(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item; ``sizes`` has a row for each item, in shares of the total."""
    room = np.full((shards, sizes.shape[1]), 1.0 / shards)
    out = np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes.max(axis=1), kind="stable"):
        fits = (room >= sizes[i] - 1e-12).all(axis=1)
        gain = room @ sizes[i]
        shard = int(np.where(fits, gain, -np.inf).argmax()) if fits.any() else int((room - sizes[i]).min(axis=1).argmax())
        out[i] = shard
        room[shard] -= sizes[i]
    load = np.bincount(out, weights=sizes[:, 0], minlength=shards)
    for _ in range(4 * len(sizes)):
        full, empty = int(load.argmax()), int(load.argmin())
        gap = load[full] - load[empty]
        mine = np.flatnonzero(out == full)
        mine = mine[(sizes[mine, 0] > 0) & (sizes[mine, 0] < gap)]
        if not len(mine):
            break
        i = mine[np.abs(sizes[mine, 0] - gap / 2).argmin()]
        out[i] = empty
        load[full] -= sizes[i, 0]
        load[empty] += sizes[i, 0]
    return out


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row per document."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    raw = text.cast("binary")
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"),
        F.crc32(raw).alias("text_crc32"),
        F.md5(raw).alias("group"),
    )
    rows = materialize(rows, "sizes").withColumn("bundle", F.pmod(F.xxhash64("group"), F.lit(shards * BUNDLES)).cast("string"))
    dims = ["size", "tokens", "n"]
    total = rows.agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).first()
    whole = {d: max(1, total[d] or 0) for d in dims}
    groups = rows.groupBy("group", "bundle").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    share = F.greatest(*[F.col(d) / F.lit(float(whole[d])) for d in dims])
    own = (share > 1.0 / (OWN * shards)) & (F.col("n") > 0)
    # A group's pieces: one up to half a shard, which the rest can still fill evenly.
    parts = F.when(share * shards <= 0.5, 1).otherwise(F.least(F.col("n"), F.ceil(share * shards * PIECE)).cast("int")).alias("parts")
    named_parts = [(r.group, r.parts) for r in groups.where(own).select("group", parts).toLocalIterator()]
    split = spark.createDataFrame(named_parts, "group string, parts int")
    item = F.when(F.col("parts").isNull(), F.col("bundle")).otherwise(F.concat_ws("-", "group", F.lit("0")))
    # This table and the next are broadcast: they hold a bounded number of items (see above).
    of = rows.join(F.broadcast(split), "group", "left")
    named = of.where(F.coalesce("parts", F.lit(1)) == 1).withColumn("item", item)
    if any(parts > 1 for _, parts in named_parts):
        # rows of a split group are dealt by their place in it, so pieces are even whatever their doc_ids are
        dealt = numbered(of.where("parts > 1"), ["group"], ["doc_id", "text_crc32"], "place", whole["n"])
        named = named.unionByName(dealt.withColumn("item", F.concat_ws("-", "group", (F.col("place") % F.col("parts")).cast("string"))).drop("place"))

    sized = named.groupBy("item").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    items = sorted(tuple(r) for r in sized.toLocalIterator())
    shares = np.array([[s / whole[d] for s, d in zip(sizes, dims)] for _, *sizes in items]).reshape(-1, len(dims))
    chosen = place(shares, shards)
    placed = spark.createDataFrame([(name, int(s)) for (name, *_), s in zip(items, chosen)], "item string, shard int")
    found = named.join(F.broadcast(placed), "item")
    slotted = numbered(found.select("doc_id", "size", "text_crc32", "shard"), ["shard"], ["doc_id", "text_crc32"], "slot", whole["n"])
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
