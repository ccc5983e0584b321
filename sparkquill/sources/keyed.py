"""Tables that hold one row a key: rows are found or made, and only the parts that change are written again.

Rows are dealt to a fixed number of slots by a hash of their key. A manifest names the folder that each slot's rows lie in;
a change reads the slots of its keys alone, writes new folders for those that change, and then a new manifest. So a change is
seen whole or not at all, files of other slots stay as they are, and doing it again changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import scratch

SLOTS = 64


def content_id(*parts: Column | str) -> Column:
    """An identifier that follows from what it names, in the form of a UUID; null parts differ from empty ones."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    framed = F.concat(*[F.when(c.isNull(), F.lit("\x00")).otherwise(F.concat(F.lit("\x01"), F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in columns])
    digest = F.sha2(framed, 256)
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(digest, a, n) for a, n in cuts])


def same_key(left: DataFrame, right: DataFrame, key: list[str]) -> Column:
    """Equality of keys, in which nulls are equal."""
    out = F.lit(True)
    for c in key:
        out = out & left[c].eqNullSafe(right[f"_{c}"])
    return out


class KeyedTable:
    """Rows of ``schema`` under a folder of the shared file system, one for each value of ``key``."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: list[str], slots: int = SLOTS):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        self.schema = StructType.fromDDL(schema)
        self.version, self.places = 0, {}
        self.slots = slots
        known = [name for name in scratch.names_in(spark, self.folder) if name.startswith("manifest-")]
        if known:
            latest = max(known, key=lambda name: int(name.split("-")[1]))
            held = json.loads(spark.read.text(f"{self.folder}/{latest}", wholetext=True).first().value)
            self.version, self.slots, self.places = int(latest.split("-")[1]), held["slots"], {int(k): v for k, v in held["places"].items()}

    def _slot(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.slots)).cast("int")

    def rows(self, slots: list[int] | None = None) -> DataFrame:
        """All rows, or those of some slots."""
        wanted = [f"{self.folder}/{place}/slot={s}" for s, place in self.places.items() if place and (slots is None or s in slots)]
        return self.spark.read.schema(self.schema).parquet(*wanted) if wanted else self.spark.createDataFrame([], self.schema)

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r.slot for r in rows.select(self._slot().alias("slot")).distinct().collect())

    def _replace(self, rows: DataFrame, slots: list[int]) -> None:
        """``rows`` are from now on all rows of ``slots``."""
        place = f"data-{uuid.uuid4().hex[:12]}"
        rows.withColumn("slot", self._slot()).repartition("slot").write.option("compression", "zstd").partitionBy("slot").parquet(f"{self.folder}/{place}")
        written = {int(n.split("=")[1]) for n in scratch.names_in(self.spark, f"{self.folder}/{place}") if n.startswith("slot=")}
        self.version += 1
        places = self.places | {s: place if s in written else None for s in slots}
        text = json.dumps({"slots": self.slots, "places": places})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{self.folder}/manifest-{self.version}")
        self.places = places

    def get_or_create(self, wanted: DataFrame) -> DataFrame:
        """The row of each key in ``wanted`` (columns of the schema), with ``created``: the one that stood, or that of ``wanted``.

        Of several wanted rows of one key the least by all columns is made. What stands is never changed.
        """
        columns = [f.name for f in self.schema]
        rest = [c for c in columns if c not in self.key]
        first = Window.partitionBy(*self.key).orderBy(*[F.col(c).asc_nulls_last() for c in rest or self.key])
        once = wanted.select(*columns).withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")
        once = scratch.saved(once, "wanted")
        there = self.rows(self._touched(once))
        held = there.toDF(*[f"_{c}" for c in columns])
        new = scratch.saved(once.join(held, same_key(once, held, self.key), "left_anti"), "new")
        touched = self._touched(new)
        asked = once.select(*[F.col(c).alias(f"_{c}") for c in self.key])
        found = scratch.saved(there.join(asked, same_key(there, asked, self.key), "left_semi"), "found")
        if touched:
            self._replace(self.rows(touched).unionByName(new), touched)
        return found.withColumn("created", F.lit(False)).unionByName(new.withColumn("created", F.lit(True)))

    def upsert(self, changed: DataFrame) -> None:
        """Rows of ``changed`` (each key once) take the place of those with their keys."""
        columns = [f.name for f in self.schema]
        new = scratch.saved(changed.select(*columns), "changed")
        touched = self._touched(new)
        if touched:
            asked = new.select(*[F.col(c).alias(f"_{c}") for c in self.key])
            there = self.rows(touched)
            self._replace(there.join(asked, same_key(there, asked, self.key), "left_anti").unionByName(new), touched)
