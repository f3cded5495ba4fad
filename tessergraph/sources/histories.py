"""Readers of histories: version-control logs and annotations, and a lines-of-code counter."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.history import KINDS

HEADER, FOOTER = "START_HEADER", "END_HEADER"
#: Letters of a log's items; renames and copies carry a similarity.
_LETTERS = {"A": "Add", "M": "Edit", "D": "Delete", "R": "Rename", "C": "Copy", "T": "TypeChanged"}
#: Of each extension: markers of line comments, pairs around block comments, and pairs around strings with the way a quote is escaped in them.
_C = (("//",), (("/*", "*/"),), (('"', "\\"), ("'", "\\")))
_MARKUP = ((), (("<!--", "-->"),), ())
SYNTAX = {
    "cs": (("//",), (("/*", "*/"),), (('@"', '""'), ('"', "\\"), ("'", "\\"))), "cpp": _C, "h": _C, "java": _C, "js": (("//",), (("/*", "*/"),), (('"', "\\"), ("'", "\\"), ("`", "\\"))), "ts": (("//",), (("/*", "*/"),), (('"', "\\"), ("'", "\\"), ("`", "\\"))), "dart": (("//",), (("/*", "*/"),), (("'''", "\\"), ('"""', "\\"), ('"', "\\"), ("'", "\\"))),
    "py": (("#",), (), (('"""', "\\"), ("'''", "\\"), ('"', "\\"), ("'", "\\"))), "vb": (("'", "REM "), (), (('"', '""'),)), "css": ((), (("/*", "*/"),), ()), "xaml": _MARKUP, "xml": _MARKUP, "resx": _MARKUP, "html": _MARKUP, "htm": _MARKUP, "txt": ((), (), ()), "md": ((), (), ()),
}


def decode_path(path: str) -> str:
    """A quoted path with octal bytes (`"caf\\303\\251"`) as text."""
    bare = path.strip('"')
    return re.sub(r"(?:\\[0-3][0-7]{2})+", lambda m: bytes(int(o, 8) for o in m[0].split("\\")[1:]).decode(errors="replace"), bare)


def read_log(spark: SparkSession, path: str, root: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """change_sets(id, committer, date, comment), items(change_set_id, ord, kind, path, from_path) and commit_edges(hash, parent, ord) of a log.

    A record is START_HEADER, hash, author, date, parents, comment lines,
    END_HEADER and then items with tabs. A record whose header is cut short is
    dropped; a comment without an end reads to the end of the record.
    """
    records = spark.read.option("lineSep", HEADER + "\n").text(path).where("trim(value) <> ''")
    lines = F.split("value", r"\r?\n")
    r = records.select(lines.alias("l")).where(F.size("l") >= 5).select("l", F.array_position("l", FOOTER).cast("int").alias("end"))
    r = r.select(F.trim(F.col("l")[0]).alias("id"), F.col("l")[1].alias("committer"), F.to_timestamp(F.trim(F.col("l")[2])).alias("date"), F.trim(F.col("l")[3]).alias("parents"), F.when(F.col("end") > 0, F.slice("l", 5, F.greatest(F.col("end") - 5, F.lit(0)))).otherwise(F.slice("l", 5, F.size("l"))).alias("comment"), F.when(F.col("end") > 0, F.filter(F.slice("l", F.col("end") + 1, F.size("l")), lambda x: F.trim(x) != "")).otherwise(F.array().cast("array<string>")).alias("items"))
    r = r.where("id <> '' and date is not null")
    sets = r.select("id", "committer", "date", F.array_join("comment", "\n").alias("comment"))
    kind = F.create_map(*[F.lit(x) for k, v in _LETTERS.items() for x in (k, KINDS[v])])
    decode = F.udf(decode_path, T.StringType(), useArrow=True)
    clean = lambda c: F.when(F.contains(c, F.lit("\\")), decode(c)).otherwise(F.regexp_replace(c, '^"|"$', ""))  # noqa: E731  only escaped paths leave the JVM
    i = r.select(F.col("id").alias("change_set_id"), F.posexplode("items").alias("ord", "line")).withColumn("p", F.split("line", "\t"))
    renamed = F.size("p") >= 3
    items = i.select("change_set_id", "ord", F.coalesce(kind[F.substring(F.col("p")[0], 1, 1)], F.lit(KINDS["None"])).alias("kind"), clean(F.when(renamed, F.get("p", F.lit(2))).otherwise(F.get("p", F.lit(1)))).alias("path"), F.when(renamed, clean(F.get("p", F.lit(1)))).alias("from_path")).where("path is not null")
    if root:
        items = items.withColumn("path", F.concat(F.lit(root.rstrip("/") + "/"), "path"))
    edges = r.where("parents <> ''").select(F.col("id").alias("hash"), F.posexplode(F.split("parents", r"\s+")).alias("ord", "parent")).select("hash", "parent", "ord")
    return sets, items, edges


def developer_work(lines: DataFrame, pattern: str = r"^\S+\s+\(\s*(.*?)\s+\d{4}-\d\d-\d\d") -> DataFrame:
    """path, developer, lines from annotated (path, line)."""
    return lines.select("path", F.regexp_extract("line", pattern, 1).alias("developer")).where("developer <> ''").groupBy("path", "developer").agg(F.count("*").alias("lines"))


def count_lines(text: str, extension: str) -> tuple[int, int]:
    """Lines that hold code, and lines that hold comments only. Blank lines are neither."""
    line_marks, blocks, strings = SYNTAX.get(extension.lower().lstrip("."), SYNTAX["txt"])
    upper = extension.lower().lstrip(".") == "vb"
    code = comments = 0
    inside: tuple[str, str, str] | None = None  # what ends it, how its end is escaped, whether it is a comment
    for line in text.splitlines():
        k, has_code, has_comment = 0, False, False
        while k < len(line):
            if inside:
                end, escape, kind = inside
                has_code |= kind == "code" and not line[k].isspace()
                has_comment |= kind == "comment" and not line[k].isspace()
                if escape == "\\" and line[k] == "\\":
                    k += 2
                elif escape == '""' and line.startswith('""', k):
                    k += 2
                elif line.startswith(end, k):
                    k += len(end)
                    inside = None
                else:
                    k += 1
                continue
            if line[k].isspace():
                k += 1
                continue
            mark = next((m for m in line_marks if (line[k : k + len(m)].upper() if upper else line[k : k + len(m)]) == m and (m[-1] != " " or not k or not line[k - 1].isalnum())), None)
            block = next((b for b in blocks if line.startswith(b[0], k)), None)
            string = next((s for s in strings if line.startswith(s[0], k)), None)
            if mark:
                has_comment = True
                break
            if block:
                has_comment, inside = True, (block[1], "", "comment")
                k += len(block[0])
            elif string:
                has_code, inside = True, (string[0].lstrip("@"), string[1], "code")
                k += len(string[0])
            else:
                has_code = True
                k += 1
        if inside and inside[2] == "code" and len(inside[0]) == 1 and inside[1] == "\\" and inside[0] != "`":
            inside = None  # such a string ends with its line
        code += has_code
        comments += has_comment and not has_code
    return code, comments


def lines_of_code(files: DataFrame, handlers: dict[str, Callable[[str], tuple[int, int]]] | None = None) -> DataFrame:
    """file, code, comments of (file, extension, text), counted a file at a time in Arrow batches; a null text has none. A handler of an extension counts in place of the syntax table."""
    own = {e.lower().lstrip("."): f for e, f in (handlers or {}).items()}

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counted = [own[(e or "").lower().lstrip(".")](t or "") if (e or "").lower().lstrip(".") in own else count_lines(t or "", e or "") for t, e in zip(pdf["text"], pdf["extension"], strict=True)]
            yield pd.DataFrame({"file": pdf["file"], "code": [c for c, _ in counted], "comments": [c for _, c in counted]})

    return files.select("file", "extension", "text").mapInPandas(run, "file string, code long, comments long")


def read_source_files(spark: SparkSession, folder: str) -> DataFrame:
    """file, extension and text of all files below a folder whose extension is known; folders that begin with a dot are left out."""
    raw = spark.read.option("recursiveFileLookup", "true").option("wholetext", "true").text(folder).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    ext = F.lower(F.regexp_extract("file", r"\.([^./]+)$", 1))
    return raw.where(~F.col("file").rlike(r"/\.[^/]+/")).select("file", ext.alias("extension"), "text").where(F.col("extension").isin(*SYNTAX))


def track_renames(items: DataFrame, change_sets: DataFrame) -> DataFrame:
    """change_set_id, ord, path, id: an id that follows a file through renames along a linear history.

    A file's id is its number of first sight in its repository (`repository` groups, or all rows as one); deletes keep
    the last id. The state at a commit depends on all before it, so a repository is one group, in order of date.
    """
    rows = items.join(change_sets.select(F.col("id").alias("change_set_id"), "date"), "change_set_id")
    rows = rows if "repository" in rows.columns else rows.withColumn("repository", F.lit(""))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        scope: dict[str, int] = {}
        ids, count = [], 0
        for r in pdf.sort_values(["date", "change_set_id", "ord"]).itertuples():
            if r.kind & KINDS["Rename"] and r.from_path in scope:
                scope[r.path] = scope.pop(r.from_path)
            elif r.path not in scope:
                scope[r.path] = count
                count += 1
            ids.append((r.change_set_id, r.ord, r.path, str(scope[r.path])))
            if r.kind & KINDS["Delete"]:
                scope.pop(r.path)
        return pd.DataFrame(ids, columns=["change_set_id", "ord", "path", "id"])

    return rows.groupBy("repository").applyInPandas(kernel, "change_set_id string, ord int, path string, id string")
