"""Discovery of packages by custom rules over directories."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    kind: str
    requires: tuple[str, ...]
    paths: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    max_depth: int | None = None
    name_prefix: str | None = None
    extensions: tuple[str, ...] = field(default=())


def glob_pattern(glob: str) -> str:
    """A file name glob (``*``, ``?``, ``[...]``) as a regular expression for whole names."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            inner = glob[i + 1 : end]
            out += "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += "\\" + c if c in r".^$+{}()|\\]" else c
        i += 1
    return f"^{out}$"


def _named(pattern: str):
    return lambda name: name.rlike(pattern)


def matching_directories(directories: DataFrame, rule: Rule, excluded: list[str]) -> DataFrame:
    """``dir`` of ``directories(dir, filenames)`` in which every required glob matches a file, beneath no other match."""
    parts = F.filter(F.split("dir", "/"), lambda p: p != "")
    found = directories.where(~F.exists(parts, lambda p: p.startswith(".") | p.isin([*excluded, *rule.exclude])))
    for g in rule.requires:
        found = found.where(F.exists("filenames", _named(glob_pattern(g))))
    if rule.paths or rule.max_depth is not None:
        inside = F.lit(False)
        for root in rule.paths or ("",):
            root = root.strip("/")
            under = (F.col("dir") == root) | F.col("dir").startswith(f"{root}/") if root else F.lit(True)
            depth = F.size(parts) - len([p for p in root.split("/") if p])
            inside = inside | (under & (F.lit(True) if rule.max_depth is None else depth <= rule.max_depth))
        found = found.where(inside)
    found = found.select("dir")
    above = found.select(F.col("dir").alias("child"), F.explode(F.expr("transform(sequence(0, size(split(dir, '/'))), k -> array_join(slice(split(dir, '/'), 1, k), '/'))")).alias("dir")).where("child <> dir")
    covered = above.join(found, "dir", "left_semi").select(F.col("child").alias("dir"))
    return found.join(covered, "dir", "left_anti")


def discover(directories: DataFrame, rules: list[Rule], excluded: list[str], known: DataFrame) -> DataFrame:
    """``name, path, kind, metadata`` of the directories that rules match and ``known(path)`` lacks; the first rule wins."""
    out = None
    for rule in rules:
        dirs = matching_directories(directories, rule, excluded).join(known.select(F.col("path").alias("dir")), "dir", "left_anti")
        if out is not None:
            dirs = dirs.join(out.select(F.col("path").alias("dir")), "dir", "left_anti")
        root = rule.name if rule.name_prefix is None else rule.name_prefix.rstrip(":")
        name = F.when(F.col("dir") == "", F.lit(root)).otherwise(F.concat(F.lit(rule.name_prefix or ""), F.col("dir")))
        rows = dirs.select(name.alias("name"), F.col("dir").alias("path"), F.lit(rule.kind).alias("kind"), F.to_json(F.struct(F.lit(rule.name).alias("custom_rule"))).alias("metadata"))
        out = rows if out is None else out.unionByName(rows)
    return out
