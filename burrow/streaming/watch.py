"""Keeping an index fresh: change events arrive as NDJSON files, and each micro-batch that matters is one rebuild."""

from __future__ import annotations

import json
import os
import signal
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burrow import config as configuration
from burrow.functions import classify, extractors
from burrow.plans import build as plans
from burrow.schema import CHANGE


def inbox(root: str) -> str:
    return os.path.join(root, ".burrow", "changes")


def state_file(root: str) -> str:
    return os.path.join(root, ".burrow", "watch.pid")


def running(root: str) -> int | None:
    """The process that watches a tree, if there is one; a file left by one that ended is removed."""
    try:
        with open(state_file(root), encoding="utf-8") as f:
            pid = int(f.read())
        os.kill(pid, 0)
        return pid
    except PermissionError:
        return pid
    except (OSError, ValueError):
        if os.path.exists(state_file(root)):
            os.remove(state_file(root))
        return None


@contextmanager
def registered(root: str):
    """Marks this process as the watcher of a tree; yields an event that a signal to end sets."""
    ended = threading.Event()
    os.makedirs(os.path.dirname(state_file(root)), exist_ok=True)
    with open(state_file(root), "w", encoding="utf-8") as f:
        f.write(str(os.getpid()))
    before = {s: signal.signal(s, lambda *_: ended.set()) for s in (signal.SIGTERM, signal.SIGINT)}
    try:
        yield ended
    finally:
        for s, handler in before.items():
            signal.signal(s, handler)
        if os.path.exists(state_file(root)):
            os.remove(state_file(root))


def send(root: str, files: list[str]) -> None:
    """Announces changed files; without a watcher this does nothing."""
    folder = inbox(root)
    if not os.path.isdir(folder):
        return
    name = uuid.uuid4().hex
    with open(os.path.join(folder, f".{name}"), "w", encoding="utf-8") as f:
        f.write(json.dumps({"files": files}) + "\n")
    os.rename(os.path.join(folder, f".{name}"), os.path.join(folder, f"{name}.json"))


def hook(text: str) -> tuple[bool, list[str]]:
    """Whether an editor's hook event asks for a rebuild, and the files that it names. Events that can't be read do."""
    try:
        event = json.loads(text)
        given = event.get("tool_input") or {}
        files = [given[k] for k in ("file_path", "notebook_path") if given.get(k)]
        return classify.should_rebuild_text(event.get("tool_name"), given.get("command")), files
    except (ValueError, AttributeError):
        return True, []


def relevant(batch: DataFrame, root: str, own: configuration.Config) -> bool:
    """Whether a batch of events has a reason to rebuild: one without files, or one with a file that matters."""
    paths = batch.select(F.explode_outer("files").alias("path"))
    extensions = [e for e in extractors.EXTRACTORS if f".{e}" not in own.exclude_extensions]
    matters = classify.is_relevant(F.col("path"), os.path.abspath(root), configuration.NAME, list(own.manifests), extensions)
    return bool(paths.agg(F.bool_or(F.col("path").isNull() | matters)).first()[0])


def watch(spark: SparkSession, root: str, db: str | None = None, checkpoint: str | None = None, once: bool = False, rebuild=None):
    """A streaming query that rebuilds per batch. Events within one trigger interval coalesce; those that arrive during
    a rebuild wait for the next batch. Lines that can't be read are skipped, a line without files asks for a rebuild
    whatever changed. An error of a rebuild is reported and the query goes on."""
    own = configuration.load(root)
    folder = inbox(root)
    os.makedirs(folder, exist_ok=True)

    def on_batch(batch: DataFrame, _: int) -> None:
        if batch.isEmpty() or not relevant(batch, root, own):
            return
        try:
            print((rebuild or plans.build)(batch.sparkSession, root, db))
        except Exception as e:  # a failed rebuild must not end the watch
            print(f"rebuild failed: {e}")

    told = spark.readStream.schema(f"{CHANGE}, unread string").option("columnNameOfCorruptRecord", "unread").json(folder).where("unread is null").drop("unread")
    stream = told.writeStream.foreachBatch(on_batch).queryName("burrow-watch").option("checkpointLocation", checkpoint or os.path.join(root, ".burrow", "watch-checkpoint"))
    return (stream.trigger(availableNow=True) if once else stream.trigger(processingTime=f"{own.debounce_ms} milliseconds")).start()
