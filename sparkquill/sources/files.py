"""Files as a source: discovery with ignore rules and hashes, through Spark's readers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

# Paths left out by default, and paths taken as sensitive.
IGNORED = [
    ".git/", "node_modules/", ".venv/", "venv/", "dist/", "build/", "target/", "coverage/", ".next/", ".cache/", "vendor/", "*.min.js",
    "*.map", "*.lock", "*.png", "*.jpg", "*.pdf", "*.exe", "*.dll", "*.so", "*.class", "*.jar", "*.zip", "*.tar", "*.gz", ".env", ".env.*",
    "*.pem", "*.key", "*.p12", "*.jks", "id_rsa*",
]
SENSITIVE = [
    ".env", ".env.*", "*.pem", "*.key", "*.p12", "*.pks", "*.pfx", "*.jks", "*.pkcs8", "*.ppk", "id_rsa*", "id_dsa*", "id_ecdsa*",
    "id_ed25519*", "*.keystore", "*.jceks", "*credential*", "*credentials*", "*secret*", "*secrets*", "*password*", ".npmrc", ".pypirc", "*.pem.my.cnf",
]


def _glob(pattern: str) -> str:
    """A glob as a regular expression over a path: ``**`` crosses folders, ``*`` and ``?`` do not."""
    part = re.compile(r"\*\*/?|\*|\?|\[[^\]]*\]|.", re.S)
    turned = {"**": ".*", "**/": "(?:.*/)?", "*": "[^/]*", "?": "[^/]"}
    return "".join(turned.get(x) or ("[^" + x[2:] if x.startswith("[!") else x if len(x) > 1 else re.escape(x)) for x in part.findall(pattern))


def rule(line: str) -> tuple[bool, str] | None:
    """A line of an ignore file -> (whether it ignores, regular expression over relative paths); null for comments and blank lines.

    ``!`` takes back, a slash at the end means folders (what lies in them), one at the start or inside ties the pattern
    to the root, except after ``**/``; other patterns fit at any depth. A rule for a folder fits all that lies in it.
    """
    text = line.strip()
    if not text or text.startswith("#"):
        return None
    takes_back = text.startswith("!")
    text = (text[1:].strip() if takes_back else text.removeprefix("\\")) or "/"
    folders, body = text.endswith("/"), text.removesuffix("/")
    tied = body.startswith("/") or ("/" in body and not body.startswith("**/"))
    body = body.removeprefix("/").removeprefix("**/")
    return (not takes_back, ("^" if tied else "(?:^|/)") + _glob(body) + ("/" if folders else "(?:/|$)")) if body else None


def verdict(path: Column, lines: list[str]) -> Column:
    """Whether a layer of ignore lines ignores a path: its last rule that fits decides; null where none does."""
    out = F.lit(None).cast("boolean")
    for found in filter(None, map(rule, lines)):
        out = F.when(path.rlike(found[1]), F.lit(found[0])).otherwise(out)
    return out


def ignored(path: Column, *layers: list[str]) -> Column:
    """Layers in order of precedence (the system's own patterns come first): the first with a verdict decides; else not ignored."""
    return F.coalesce(*[verdict(path, lines) for lines in (IGNORED, *layers)], F.lit(False))


def sensitive(path: Column) -> Column:
    """By the file's name alone, in any folder."""
    return F.element_at(F.split(path, "/"), -1).rlike("|".join("^" + _glob(p) + "$" for p in SENSITIVE))


def is_binary(content: Column) -> Column:
    """A zero byte among the first 8192."""
    return F.locate("\u0000", F.decode(F.substring(content, 1, 8192), "ISO-8859-1")) > 0


# Extensions and first bytes of files that are no text.
BINARY_EXTENSIONS = (
    "png jpg jpeg gif bmp webp ico tif tiff pdf doc docx xls xlsx ppt pptx zip jar gz tar tgz bz2 xz 7z rar zst exe dll so dylib class obj o a lib "
    "wasm pyc pyo pyd woff woff2 ttf otf eot db sqlite sqlite3 mdb bin iso img"
).split()
BINARY_BYTES = (
    "89504E470D0A1A0A FFD8FF 474946383761 474946383961 424D CAFEBABE CAFEBABB FEEDFACE CEFAEDFE FEEDFACF CFFAEDFE 7F454C46 4D5A 504B0304 504B0506 504B0708 "
    "1F8B 1F9D 1FA0 425A68 FD377A585A00 28B52FFD 255044462D 00000100 0061736D"
).split()


def is_binary_file(path: Column, content: Column) -> Column:
    """Whether a file is no text: by its extension, its first bytes, or a zero byte among the first 8192; an empty file is text."""
    extension = F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"[.]([^.]+)$", 1))
    first = F.hex(F.substring(content, 1, 8))
    return (F.octet_length(content) > 0) & (extension.isin(BINARY_EXTENSIONS) | first.rlike("^(?:" + "|".join(BINARY_BYTES) + ")") | is_binary(content))


def manifest_hash(files: DataFrame) -> DataFrame:
    """One revision for all of ``files`` (path, content_hash): the hash of their sorted lines. A manifest holds names and hashes, no contents."""
    lines = F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "path", "content_hash"))), "\n")
    return files.agg(F.sha2(lines, 256).alias("revision"))


def discover(spark: SparkSession, folder: str, most_bytes: int = 2 << 20, *layers: list[str]) -> DataFrame:
    """path, length, content_hash, is_binary, language, is_generated of the files under ``folder`` that no rule leaves out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    path = F.substring_index(F.col("path"), folder.rstrip("/") + "/", -1)
    named = files.where(F.col("length") <= most_bytes).select(path.alias("path"), "length", "content")
    kept = named.where(~ignored(F.col("path"), *layers) & ~sensitive(F.col("path")))
    return kept.select("path", "length", F.sha2("content", 256).alias("content_hash"), is_binary(F.col("content")).alias("is_binary"), T.language(F.col("path")).alias("language"), T.is_generated(F.col("path")).alias("is_generated"))
