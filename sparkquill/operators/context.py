"""From ranked hits to a context, citations and a prompt, for a batch of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

MOST_CHUNKS, MOST_TOKENS, WIDTH = 8, 12_000, 1
SNIPPET = 200


def candidates(hits: DataFrame, chunks: DataFrame, width: int = WIDTH) -> DataFrame:
    """qid, place, chunk_id, relation, content_hash, token_count: what could stand in each query's context, in order.

    hits (qid, chunk_id, rank), chunks (chunk_id, source_id, sequence_no, parent_chunk_id, content_hash, token_count).
    Each hit stands itself, then its parent, then its neighbours by distance; of equal contents the first stays.
    Neighbours are sought by an equal key (source and shifted number), so no band join is needed. Where chunks have a ``content`` and a
    ``row_group_header`` or a ``signature``, these stand before a hit whose content doesn't hold them, with a hash and tokens of their own.
    """
    found = hits.join(chunks.select("chunk_id", "source_id", "sequence_no", "parent_chunk_id"), "chunk_id")
    shifts = [s for d in range(1, width + 1) for s in (-d, d)]
    body = chunks.select("chunk_id", "content_hash", "token_count")
    named = [
        found.select("qid", "rank", F.lit(0).alias("step"), "chunk_id", F.lit("self").alias("relation")),
        found.where("parent_chunk_id is not null").select("qid", "rank", F.lit(1).alias("step"), F.col("parent_chunk_id").alias("chunk_id"), F.lit("parent").alias("relation")),
    ]
    if shifts:
        around = F.explode(F.array(*[F.struct(F.lit(s).alias("by"), F.lit(i + 2).alias("step")) for i, s in enumerate(shifts)])).alias("a")
        asked = found.select("qid", "rank", "source_id", "sequence_no", around).select("qid", "rank", "source_id", (F.col("sequence_no") + F.col("a.by")).alias("sequence_no"), F.col("a.step").alias("step"))
        beside = asked.join(chunks.select("source_id", "sequence_no", "chunk_id"), ["source_id", "sequence_no"])
        named.append(beside.select("qid", "rank", "step", "chunk_id", F.lit("neighbour").alias("relation")))
    rows = named[0]
    for more in named[1:]:
        rows = rows.unionByName(more)
    once = Window.partitionBy("qid", "content_hash").orderBy("rank", "step", "chunk_id")
    order = Window.partitionBy("qid").orderBy("rank", "step", "chunk_id")
    rows = rows.join(body, "chunk_id")
    for step, column in ((-2, "row_group_header"), (-1, "signature")):
        if column in chunks.columns:
            lead = F.trim(F.col(column))
            before = hits.join(chunks.select("chunk_id", "content", column), "chunk_id").where((lead != "") & ~F.contains(F.coalesce("content", F.lit("")), lead))
            rows = rows.unionByName(before.select("qid", "rank", F.lit(step).alias("step"), "chunk_id", F.lit(column).alias("relation"), F.sha2(column, 256).alias("content_hash"), T.naive_tokens(F.col(column)).cast(body.schema["token_count"].dataType).alias("token_count")))
    first = rows.withColumn("nth", F.row_number().over(once)).where("nth = 1 or content_hash is null")
    return first.select("qid", F.row_number().over(order).alias("place"), "chunk_id", "relation", "content_hash", "token_count")


def build(hits: DataFrame, chunks: DataFrame, most_chunks: int = MOST_CHUNKS, most_tokens: int = MOST_TOKENS, width: int = WIDTH) -> DataFrame:
    """qid, position, chunk_id, relation, truncated: the contexts.

    In order, a candidate that fits the token budget is taken, one that doesn't is skipped and marks the context as
    truncated, and nothing is taken after ``most_chunks``. A query has at most hits x (2 + 2 x width) candidates,
    so the fold over its sorted array is small and stays in the JVM.
    """
    piece = F.struct("place", "chunk_id", "relation", F.col("token_count").cast("long").alias("token_count"))
    rows = candidates(hits, chunks, width).groupBy("qid").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    kept = F.filter("pieces", lambda p: F.lit(False))
    start = F.struct(kept.alias("kept"), F.lit(0).cast("long").alias("tokens"), F.lit(False).alias("truncated"))

    def step(acc: Column, p: Column) -> Column:
        full = F.size(acc["kept"]) >= most_chunks
        fits = acc["tokens"] + p["token_count"] <= most_tokens
        return F.struct(
            F.when(~full & fits, F.array_append(acc["kept"], p)).otherwise(acc["kept"]).alias("kept"),
            F.when(~full & fits, acc["tokens"] + p["token_count"]).otherwise(acc["tokens"]).alias("tokens"),
            (acc["truncated"] | (~full & ~fits)).alias("truncated"),
        )

    folded = rows.select("qid", F.aggregate("pieces", start, step).alias("c"))
    return folded.select("qid", "c.truncated", F.posexplode("c.kept").alias("at", "p")).select("qid", (F.col("at") + 1).alias("position"), "p.chunk_id", "p.relation", "truncated")


def citations(contexts: DataFrame, chunks: DataFrame) -> DataFrame:
    """qid, label (S1, S2, ...), chunk_id, snippet; chunks without content are left out before they are labelled."""
    rows = contexts.join(chunks.select("chunk_id", "content"), "chunk_id").where("content is not null and content <> ''")
    order = Window.partitionBy("qid").orderBy("position")
    return rows.select("qid", F.concat(F.lit("S"), F.row_number().over(order)).alias("label"), "chunk_id", F.substring("content", 1, SNIPPET).alias("snippet"))


def evidence_block(label: Column, row: Column) -> Column:
    """The block of one piece of evidence, laid out for code or for documents; parts that are not known are left out.

    ``row`` has is_code, repository, document_name, file_path, symbol_name, line_start, line_end, heading_path, page_start, page_end, content.
    """
    known = lambda c: F.when(c != "", c)
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value))
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    a, z = row["line_start"], row["line_end"]
    lines = F.when(a.isNotNull() | z.isNotNull(), F.concat(shown(a), F.lit("-"), shown(z)))
    p, q = row["page_start"], row["page_end"]
    pages = F.when(p.isNotNull() | q.isNotNull(), F.concat(shown(p), F.when(q.isNotNull(), F.concat(F.lit("-"), q.cast("string"))).otherwise(F.lit(""))))
    path = F.when(F.size(F.coalesce(row["heading_path"], F.array())) > 0, F.array_join(F.filter(row["heading_path"], lambda h: F.coalesce(h, F.lit("")) != ""), " > "))
    coded = F.array(line("Repository", F.coalesce(known(row["repository"]), known(row["document_name"]), F.lit("?"))), line("Dosya", known(row["file_path"])), line("Sembol", known(row["symbol_name"])), line("Satırlar", lines))
    plain = F.array(line("Belge", known(row["document_name"])), line("Bölüm", path), line("Sayfa", pages))
    body = F.concat(F.lit("İçerik: "), F.coalesce(row["content"], F.lit("")))
    return F.array_join(F.array_compact(F.concat(F.array(F.concat(F.lit("["), label, F.lit("]"))), F.when(F.coalesce(row["is_code"], F.lit(False)), coded).otherwise(plain), F.array(body))), "\n")


def prompts(contexts: DataFrame, chunks: DataFrame, head: str = "Answer from the evidence alone.") -> DataFrame:
    """qid, prompt: the evidence blocks of each query in order, under one head."""
    rows = contexts.join(chunks.select("chunk_id", "content"), "chunk_id").where("content is not null and content <> ''")
    order = Window.partitionBy("qid").orderBy("position")
    block = F.struct(F.row_number().over(order).alias("n"), F.col("content")).alias("b")
    blocks = rows.select("qid", block).groupBy("qid").agg(F.sort_array(F.collect_list("b")).alias("bs"))
    text = F.array_join(F.transform("bs", lambda b: F.concat(F.lit("[S"), b["n"], F.lit("]\n"), b["content"])), "\n\n")
    return blocks.select("qid", F.concat(F.lit(head + "\n\n"), text).alias("prompt"))
