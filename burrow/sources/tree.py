"""``repo_tree``: a source tree as a table, by a Python data source.

The driver lists directories (pruning hidden, excluded and git-ignored ones before it descends) and deals them out as
partitions; executors read the files. The root must be on a file system that all executors mount.
"""

from __future__ import annotations

import fnmatch
import os
import re
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from burrow.schema import TREE


class Ignore:
    """Rules of one ``.gitignore``; the last rule that matches a path decides."""

    def __init__(self, base: str, text: str):
        self.base, self.rules = base, []
        for line in text.splitlines():
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            negated = line.startswith("!")
            line = line[1:] if negated else line.removeprefix("\\")
            only_dirs, line = line.endswith("/"), line.rstrip("/")
            anchored, line = "/" in line, line.lstrip("/")
            parts = ["(?:.*/)?" if p == "**" else fnmatch.translate(p)[len("(?s:") : -len(r")\Z")].replace(".*", "[^/]*") + "/" for p in line.split("/")]
            pattern = "".join(parts).rstrip("/")
            self.rules.append((re.compile(("" if anchored else "(?:.*/)?") + pattern + r"\Z", re.S), negated, only_dirs))

    def decide(self, path: str, is_dir: bool) -> bool | None:
        inner = path[len(self.base) :].lstrip("/") if self.base else path
        found = None
        for pattern, negated, only_dirs in self.rules:
            if (is_dir or not only_dirs) and pattern.match(inner):
                found = not negated
        return found


def directories(root: str, exclude: tuple[str, ...], gitignore: bool = True):
    """``(directory, file names)`` of the tree, directories relative to the root, in order."""
    stack: list[tuple[str, list[Ignore]]] = [("", [])]
    while stack:
        directory, rules = stack.pop()
        entries = sorted(os.scandir(os.path.join(root, directory)), key=lambda e: e.name)
        if gitignore and any(e.name == ".gitignore" for e in entries):
            with open(os.path.join(root, directory, ".gitignore"), encoding="utf-8", errors="replace") as f:
                rules = [*rules, Ignore(directory, f.read())]
        files, inner = [], []
        for e in entries:
            path = f"{directory}/{e.name}" if directory else e.name
            is_dir = e.is_dir(follow_symlinks=False)
            decided = next((d for r in reversed(rules) if (d := r.decide(path, is_dir)) is not None), False)
            if e.name.startswith(".") or decided or is_dir and e.name in exclude:
                continue
            if is_dir:
                inner.append((path, rules))
            elif e.is_file():
                files.append(e.name)
        yield directory, files
        stack += reversed(inner)


class Directories(InputPartition):
    def __init__(self, listed: list[tuple[str, list[str]]]):
        self.listed = listed


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.exclude = tuple(x for x in options.get("exclude", "").split(",") if x)
        self.content = re.compile(options.get("content", r".*"))
        self.per = int(options.get("filesperpartition", "2000"))

    def partitions(self):
        out, held, n = [], [], 0
        for directory, files in directories(self.root, self.exclude):
            if files:
                held.append((directory, files))
                n += len(files)
            if n >= self.per:
                out.append(Directories(held))
                held, n = [], 0
        return [*out, Directories(held)]

    def read(self, partition):
        for directory, files in partition.listed:
            for name in files:
                path = f"{directory}/{name}" if directory else name
                full = os.path.join(self.root, path)
                try:
                    s = os.stat(full)
                    size, mtime = s.st_size, datetime.fromtimestamp(s.st_mtime, timezone.utc)
                except OSError:
                    size, mtime = 0, None
                content = None
                if self.content.fullmatch(name):
                    with open(full, "rb") as f:
                        content = f.read()
                stem, dot, extension = name.rpartition(".")
                yield path, directory, name, extension.lower() if dot and stem else "", size, mtime, content


class RepoTree(DataSource):
    """Options: ``path``, ``exclude`` (directory names, comma-separated), ``content`` (pattern of the names that are read)."""

    @classmethod
    def name(cls):
        return "repo_tree"

    def schema(self):
        return TREE

    def reader(self, schema):
        return Reader({k.lower(): v for k, v in self.options.items()})


def read_tree(spark, root: str, exclude=(), content: str = ".*"):
    spark.dataSource.register(RepoTree)
    return spark.read.format("repo_tree").option("exclude", ",".join(exclude)).option("content", content).load(root)
