"""Archives as a source: their members as rows, read inside tasks, with guards."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names

MOST_ENTRIES, MOST_BYTES, MOST_ENTRY_BYTES = 20_000, 1 << 30, 2 << 20
#: Members of about this many bytes leave a task at once.
_BATCH = 16 << 20


def _zip(raw: bytes) -> Iterator[tuple[str, int, bool, object]]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for m in z.infolist():
            if not m.is_dir():
                yield m.filename, m.file_size, False, lambda m=m: z.read(m)


def _tar(raw: bytes) -> Iterator[tuple[str, int, bool, object]]:
    with tarfile.open(fileobj=io.BytesIO(raw), mode="r:*") as t:
        for m in t:
            if not m.isdir():
                opened = t.extractfile(m) if m.isfile() else None
                yield m.name, m.size, not m.isfile(), lambda o=opened: o.read()


def _members(raw: bytes) -> Iterator[tuple[str, int, bool, object]]:
    return _zip(raw) if zipfile.is_zipfile(io.BytesIO(raw)) else _tar(raw)


def _size(raw: bytes, entries: int, total: int, entry: int) -> str | None:
    """Why an archive is refused as a whole; declared sizes bound what is read, and counting ends at the first limit passed."""
    n = held = 0
    for _, size, link, _ in _members(raw):
        n, held = n + 1, held + (size if size <= entry and not link else 0)
        if n > entries:
            return "too_many_entries"
        if held > total:
            return "too_large"
    return None


def expand(archives: DataFrame, entries: int = MOST_ENTRIES, total: int = MOST_BYTES, entry: int = MOST_ENTRY_BYTES) -> DataFrame:
    """path, entry, content, problem, revision from archives (path, content): a row for each member of ZIP and TAR files.

    problem: null for members read; ``link``, ``outside`` (of the root) or ``oversized`` for those left out; an archive that
    is ``unreadable``, ``too_many_entries`` or ``too_large`` gives one row without an entry. Null contents give no row.
    revision is the hash of the archive's bytes. Archives are read within tasks, a batch of members at a time.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names_ = ["path", "raw_entry", "content", "problem", "revision"]
        types = [pa.string(), pa.string(), pa.binary(), pa.string(), pa.string()]
        out = lambda rows: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names_)
        for batch in batches:
            for i in range(batch.num_rows):
                path, raw, revision = (batch.column(c)[i].as_py() for c in ("path", "content", "revision"))
                rows, held = [], 0
                try:
                    refused = _size(raw, entries, total, entry)
                    for name, size, link, data in () if refused else _members(raw):
                        problem = "link" if link else "oversized" if size > entry else None
                        rows.append((path, name, None if problem else data(), problem, revision))
                        held += 0 if problem else size
                        if held > _BATCH:
                            yield out(rows)
                            rows, held = [], 0
                except (zipfile.BadZipFile, tarfile.TarError, EOFError, OSError, RuntimeError, NotImplementedError):
                    refused = "unreadable"
                if refused:
                    rows.append((path, None, None, refused, revision))
                if rows:
                    yield out(rows)

    read = archives.where("content is not null").select("path", "content", F.sha2("content", 256).alias("revision"))
    rows = read.mapInArrow(walk, "path string, raw_entry string, content binary, problem string, revision string")
    inside = names.member_path(F.col("raw_entry"))
    problem = F.coalesce("problem", F.when(F.col("raw_entry").isNotNull() & inside.isNull(), "outside"))
    rows = rows.select("path", inside.alias("inside"), "raw_entry", "content", problem.alias("problem"), "revision")
    return rows.select("path", F.coalesce("inside", "raw_entry").alias("entry"), F.when(F.col("problem").isNull(), F.col("content")).alias("content"), "problem", "revision")
