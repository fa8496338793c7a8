"""Classifier of shell commands that only read, and relevance of changed paths, as SQL expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Commands, or their beginnings, that leave a source tree as it is.
READ_ONLY = (
    "cat", "head", "tail", "less", "more", "ls", "dir", "find", "fd", "tree", "grep", "rg", "ag", "ack", "wc", "diff", "cmp", "file", "stat",
    "echo", "printf", "true", "false", "pwd", "which", "whereis", "whence", "type", "command", "env", "printenv", "set",
    "ps", "top", "htop", "uptime", "df", "du", "free", "date", "cal", "man", "help", "info",
    "git status", "git log", "git diff", "git show", "git branch", "git remote", "git tag", "git stash list", "git rev-parse",
    "cargo test", "cargo check", "cargo clippy", "cargo bench", "cargo doc", "cargo build", "go test", "go vet", "go build",
    "npm test", "npm run test", "npm run lint", "npm run build", "npx", "yarn test", "pnpm test",
    "python -c", "python -m pytest", "pytest", "node -e", "make check", "make test", "jq", "yq", "xargs", "curl", "wget", "http",
    "docker ps", "docker images", "docker logs", "kubectl get", "kubectl describe", "kubectl logs",
    "gh pr view", "gh issue view", "gh api", "gh run view",
)


def segments(command: Column) -> Column:
    """The parts of a command line between pipes, semicolons and ``&&``, without an opening bracket."""
    outer = F.transform(F.split(command, r"[|;]"), lambda s: F.trim(F.regexp_replace(F.trim(s), r"^\(+", "")))
    inner = F.flatten(F.transform(outer, lambda s: F.transform(F.split(s, "&&"), lambda x: F.trim(x))))
    return F.filter(inner, lambda s: s != "")


def is_read_only(command: Column) -> Column:
    prefixes = F.array(*(F.lit(p) for p in READ_ONLY))
    return F.forall(segments(command), lambda s: F.exists(prefixes, lambda p: F.startswith(s, p)))


def should_rebuild(tool: Column, command: Column) -> Column:
    """False only for shell commands all of whose segments only read."""
    return F.coalesce(tool != "Bash", F.lit(True)) | command.isNull() | ~F.coalesce(is_read_only(command), F.lit(False))


def should_rebuild_text(tool: str | None, command: str | None) -> bool:
    """The same for one event, on the driver."""
    if tool != "Bash" or command is None:
        return True
    parts = [y.strip() for x in re.split(r"[|;]", command) for y in x.strip().lstrip("(").split("&&")]
    return not all(p.startswith(READ_ONLY) for p in parts if p)


def is_relevant(path: Column, root: str, config_name: str, manifests: list[str], extensions: list[str]) -> Column:
    """Whether a changed path concerns the index: under the root, and the config file, a manifest or a tracked source."""
    name = F.substring_index(path, "/", -1)
    extension = F.when(name.contains("."), F.substring_index(name, ".", -1)).otherwise("")
    return F.startswith(path, F.lit(root.rstrip("/") + "/")) & ((name == config_name) | name.isin(manifests) | extension.isin(extensions))
