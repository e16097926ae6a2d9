"""Rules on relative paths: what is a sound path, what is never read, what is a source, what ignore files leave out."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import extension, file_name

#: Bytes of a path and of a part of it, parts of a path.
PATH_BYTES, PART_BYTES, PARTS = 4096, 255, 256
#: Extensions that are read, and the dialects that they stand for when they are in lower case.
DIALECTS = {
    "rs": "rust", "go": "go", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "jsx", "ts": "typescript", "mts": "typescript",
    "cts": "typescript", "tsx": "tsx", "cs": "csharp", "java": "java", "dart": "dart",
}
#: Directories, names and suffixes that are never read.
DENIED_DIRECTORIES = (".git", ".dart_tool", ".gradle", "node_modules", "target", "bin", "obj", "build", "dist", "vendor")
DENIED_NAMES = (".env", "credentials", "credentials.json", "id_rsa", "id_dsa", "id_ed25519")
DENIED_SUFFIXES = (".pem", ".key", ".p12", ".pfx", ".crt", ".cer", ".min.js", ".min.mjs", ".min.cjs")
#: Names of ignore files; a project's own name may be added.
IGNORE_FILES = (".gitignore", ".ignore")
MANIFESTS = ("go.mod", "pubspec.yaml")


def valid_path(path: Column) -> Column:
    """A relative path without empty, '.' or '..' parts, NUL, backslash or drive, of bounded size."""
    parts = F.split(path, "/")
    sound = ~path.rlike(r"[\x00\\]|^[A-Za-z]:") & (F.octet_length(path) <= PATH_BYTES) & (F.size(parts) <= PARTS)
    return F.coalesce(sound & F.forall(parts, lambda p: (p != "") & (p != ".") & (p != "..") & (F.octet_length(p) <= PART_BYTES)), F.lit(False))


def denied(path: Column) -> Column:
    """Never read, whatever ignore files say; names fold letters."""
    low = F.lower(path)
    name = file_name(low)
    inside = F.exists(F.split(low, "/"), lambda p: p.isin(*DENIED_DIRECTORIES))
    ends = F.lit(False)
    for suffix in DENIED_SUFFIXES:
        ends = ends | name.endswith(suffix)
    return inside | name.startswith(".env.") | name.isin(*DENIED_NAMES) | ends


def supported(path: Column) -> Column:
    return extension(path).isin(*DIALECTS)


def dialect(path: Column) -> Column:
    """The dialect of a path by its extension in its own case; null for .RS, although supported() takes it."""
    ext = F.regexp_extract(file_name(path), r"\.([^.]+)$", 1)
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for e, d in DIALECTS.items():
        chain = chain.when(ext == e, d)
    return chain


def glob_regex(pattern: str, base: str = "") -> tuple[str, bool, bool] | None:
    """(regular expression, whether it takes a path back in, whether it is for directories only) of one ignore line.

    base: the directory of the ignore file. None for blank lines and comments.
    """
    line = pattern.rstrip("\n\r")
    line = re.sub(r"(?<!\\)\s+$", "", line)
    if not line or line.startswith("#"):
        return None
    keep = line.startswith("!")
    line = line[1:] if keep else line.removeprefix("\\")
    only_dirs = line.endswith("/")
    line = line.rstrip("/")
    rooted = "/" in line
    line = line.lstrip("/")
    out, i = [], 0
    while i < len(line):
        if line.startswith("**/", i) and (i == 0 or line[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
        elif line[i : i + 2] == "**" and i + 2 == len(line) and i and line[i - 1] == "/":
            out.append(".+")
            i += 2
        elif line[i] == "*":
            out.append("[^/]*")
            i += 1
        elif line[i] == "?":
            out.append("[^/]")
            i += 1
        elif line[i] == "[" and (end := line.find("]", i + 2)) > 0:
            body = line[i + 1 : end]
            body = ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append(f"(?!/)[{body}]")
            i = end + 1
        else:
            step = 1 if line[i] != "\\" or i + 1 == len(line) else 2
            out.append(re.sub(r"([^A-Za-z0-9_/ -])", r"\\\1", line[i + step - 1]))
            i += step
    prefix = re.sub(r"([^A-Za-z0-9_/ -])", r"\\\1", base) + "/" if base else ""
    return f"^{prefix}{'' if rooted else '(?:.*/)?'}{''.join(out)}$", keep, only_dirs


def ignored(paths: DataFrame, rules: list[tuple[str, bool, bool]], column: str = "relative_path") -> DataFrame:
    """Paths with `ignored`: the last rule that matches decides, for the path or for the nearest directory above that one ignores.

    A directory that is left out leaves out all below it, also what a later rule would take back in.
    """
    parts = F.split(F.col(column), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("p"), (n < F.size(parts)).alias("dir")))

    def verdict(node: Column) -> Column:
        chain = F.lit(False)
        for regex, keep, only_dirs in rules:
            match = node["p"].rlike(regex) & (node["dir"] if only_dirs else F.lit(True))
            chain = F.when(match, F.lit(not keep)).otherwise(chain)
        return chain

    return paths.withColumn("ignored", F.exists(above, verdict))
