"""Names, keys, kinds and encodings of files, as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

# The kind of an extension (any other extension is text), the encodings in the order they are tried, the
# marks that name one, the fields of an embedding profile, and the fields that a log line may hold.
KINDS = {"pdf": "pdf", "docx": "office", "xlsx": "office", "pptx": "office"} | dict.fromkeys(("png", "jpg", "jpeg", "gif", "bmp", "tif", "tiff", "webp"), "image")
ENCODINGS = ["utf-8", "cp1254", "cp1252", "latin-1"]
MARKS = {b"\xff\xfe\x00\x00": "utf-32-le", b"\x00\x00\xfe\xff": "utf-32-be", b"\xff\xfe": "utf-16-le", b"\xfe\xff": "utf-16-be"}
PROFILE = ["provider", "model", "dimension", "distance_metric", "query_prefix", "passage_prefix", "profile_version"]
LOG_FIELDS = [
    "request_id", "project_id", "document_id", "version_id", "job_id", "parser", "ocr_engine", "chunker_profile", "embedding_profile",
    "query_id", "retrieval_stage", "candidate_count", "latency_ms", "error_code",
]
MOST_NAME, DEFAULT_NAME = 200, "file"


@F.pandas_udf(StringType())
def _composed(names: pd.Series) -> pd.Series:
    return names.map(lambda s: s if s is None else unicodedata.normalize("NFKC", s))


def safe_name(name: Column) -> Column:
    """A name as one segment of a key: its last segment in compatible characters, others turned to ``_``, no dots or
    underscores at its ends, at most 200 characters and then with its extension; ``file`` where nothing is left or given."""
    # Only names beyond ASCII have another form; the rest goes to Python as nulls.
    plain = F.coalesce(_composed(F.when(name.rlike(r"[^\x00-\x7F]"), name)), name, F.lit(""))
    last = F.element_at(F.split(plain, r"[/\\]"), -1)
    clean = F.btrim(F.regexp_replace(F.regexp_replace(last, r"\p{C}", ""), "[^A-Za-z0-9._-]+", "_"), F.lit("._"))
    extension = F.regexp_extract(clean, r"[.][^.]{1,19}$", 0)
    cut = F.concat(F.left(clean, F.lit(MOST_NAME) - F.length(extension)), extension)
    return F.when(clean == "", DEFAULT_NAME).when(F.length(clean) > MOST_NAME, cut).otherwise(clean)


def segment(value: Column) -> Column:
    """An id as a segment of a key; null where it is empty or could leave its folder."""
    return F.when((value != "") & ~value.rlike(r"[/\\]") & ~value.isin(".", ".."), value)


def object_key(project: Column, document: Column, version: Column, *rest: Column) -> Column:
    """The key of an object of a version; null if an id or a part of it is null or no segment."""
    return F.concat(F.lit("projects/"), segment(project), F.lit("/documents/"), segment(document), F.lit("/versions/"), segment(version), *[x for part in rest for x in (F.lit("/"), part)])


def original_key(project: Column, document: Column, version: Column, name: Column) -> Column:
    return object_key(project, document, version, F.lit("original"), safe_name(name))


def normalized_key(project: Column, document: Column, version: Column, kind: str = "json") -> Column:
    return object_key(project, document, version, F.lit("normalized"), F.lit(f"document.{kind}"))


def member_path(name: Column) -> Column:
    """The path of an archive's member below the root; null for absolute paths, drives, empty ones and those that leave it.

    ``..`` takes back one folder; depth is followed from part to part, so leaving the root and coming back is refused too.
    """
    parts = F.filter(F.split(name, r"[/\\]"), lambda p: ~p.isin("", "."))
    none = F.array().cast("array<string>")
    walked = F.aggregate(
        parts,
        F.struct(none.alias("kept"), F.lit(True).alias("inside")),
        lambda s, p: F.struct(
            F.when(p != "..", F.concat(s["kept"], F.array(p))).when(F.size(s["kept"]) > 0, F.slice(s["kept"], F.lit(1), F.size(s["kept"]) - 1)).otherwise(none).alias("kept"),
            (s["inside"] & ((p != "..") | (F.size(s["kept"]) > 0))).alias("inside"),
        ),
    )
    return F.when(~name.rlike(r"^(?:[/\\]|.:)") & walked["inside"] & (F.size(walked["kept"]) > 0), F.array_join(walked["kept"], "/"))


def kind_of_name(name: Column) -> Column:
    """pdf, office, image or text by the extension; null without one."""
    extension = F.lower(F.regexp_extract(F.element_at(F.split(name, "/"), -1), r"[^.].*[.]([^.]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return F.when(extension != "", F.coalesce(F.try_element_at(known, extension), F.lit("text")))


def kind_of_mime(mime: Column) -> Column:
    """pdf, office, image or text by the MIME type, whatever its parameters; null for other types."""
    plain = F.lower(F.trim(F.substring_index(mime, ";", 1)))
    return (
        F.when(plain == "application/pdf", "pdf")
        .when(plain.rlike("openxmlformats-officedocument.*(?:wordprocessingml|spreadsheetml|presentationml)"), "office")
        .when(F.startswith(plain, F.lit("image/")), "image")
        .when(plain.rlike("^(?:text/|application/(?:json|x-|xml))"), "text")
    )


def _decoded(raw: bytes | None) -> tuple[str | None, str | None]:
    if raw is None:
        return None, None
    for mark, name in MARKS.items():
        if raw.startswith(mark):
            return raw[len(mark) :].decode(name, "replace").lstrip("\ufeff"), name
    for name in ENCODINGS:
        try:
            return raw.decode(name), name
        except UnicodeDecodeError:
            pass
    return raw.decode("utf-8", "replace"), "utf-8"


@F.pandas_udf(StructType().add("text", StringType()).add("encoding", StringType()))
def _guessed(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_decoded(raw) for raw in content], columns=["text", "encoding"], index=content.index)


def decoded(content: Column) -> Column:
    """text and encoding of bytes: by a mark at their start, else the first encoding that fits. Null gives nulls.

    Valid UTF-8 never leaves the JVM; the rest is decoded in Python. Bytes that a mark's encoding can't hold are replaced.
    """
    valid = F.is_valid_utf8(content.cast("string"))
    marked = F.startswith(content, F.lit(b"\xef\xbb\xbf"))
    native = F.struct(F.when(marked, F.substring(content, 4, 1 << 30)).otherwise(content).cast("string").alias("text"), F.when(marked, "utf-8-sig").otherwise("utf-8").alias("encoding"))
    return F.when(valid, native).otherwise(_guessed(F.when(~valid, content)))


def profile_hash(**fields: Column) -> Column:
    """The hash of an embedding profile's fields, each framed by its name, so that neighbours can't run into each other."""
    value = lambda f: F.coalesce(fields.get(f, F.lit(None)).cast("string"), F.lit("<__none__>"))
    return F.sha2(F.concat(*[x for f in PROFILE for x in (F.lit(f + "\0"), value(f), F.lit("\0"))]), 256)


def needs_ocr(source_type: Column, share: Column, enabled: bool = True, digital: float = 0.75) -> Column:
    """Images always, other sources if their share of pages with text is unknown or low."""
    return F.lit(enabled) & ((source_type == "image") | F.coalesce(share < digital, F.lit(True)))


def log_line(**fields: Column) -> Column:
    """A log line as JSON: known fields alone, in their order, without nulls."""
    return F.to_json(F.struct(*[fields[f].alias(f) for f in LOG_FIELDS if f in fields]))
