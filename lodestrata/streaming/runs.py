"""Scheduled runs: one at a time by a lease in a shared folder, each stopped at its deadline.

A run takes the next number in the folder by putting a file there that nobody has put
before.  It may if the run before has ended, or has given no sign of life for
``patience`` seconds by the store's own clock; otherwise it does nothing.  While it
works, a thread renews its sign of life and looks whether somebody has taken a higher
number: then, or at the deadline, the jobs that carry the run's tag (those of streams
that it starts too) are cancelled until the work has ended.  What a stream has finished
stays in its checkpoint, so the next run goes on from there.

Work outside of Spark can't be stopped from here; long loops of it call ``check()``.
"""

from __future__ import annotations

import datetime as dt
import json
import logging
import threading
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from ..operators.versioned import _Files

log = logging.getLogger(__name__)

#: The longest that a run takes, in seconds, and the hour (UTC) it starts at.
CAP, HOUR = 3 * 3600, 2
DONE, SKIPPED, STOPPED, LOST, FAILED, RUNNING = "done", "skipped", "stopped", "lost", "failed", "running"


class Interrupted(RuntimeError):
    """The run is over its deadline, or another has taken its place."""


def next_start(after: dt.datetime, hour: int = HOUR) -> dt.datetime:
    """The first daily start later than ``after``."""
    start = after.replace(hour=hour, minute=0, second=0, microsecond=0)
    return start if start > after else start + dt.timedelta(days=1)


class _Folder(_Files):
    def __init__(self, spark: SparkSession, folder: str) -> None:
        super().__init__(spark, folder)
        self.folder = folder.rstrip("/")

    def put(self, name: str, text: str) -> None:
        stream = self.system.create(self._path(f"{self.folder}/{name}"), True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()

    def modified(self, name: str) -> float | None:
        where = self._path(f"{self.folder}/{name}")
        return self.system.getFileStatus(where).getModificationTime() / 1000 if self.system.exists(where) else None

    def now(self) -> float:
        """The store's clock, so that the hosts' own don't matter."""
        name = f"clock.{uuid.uuid4().hex}"
        self.put(name, "")
        try:
            return self.modified(name)
        finally:
            self.remove(f"{self.folder}/{name}")

    def numbers(self, kind: str) -> list[int]:
        return sorted(int(x.split(".")[0]) for x in self.names(self.folder) if x.endswith(f".{kind}") and x.split(".")[0].isdigit())

    def alive(self, number: int, patience: float) -> bool:
        """Whether a run has neither ended nor fallen silent."""
        if self.modified(f"{number:09d}.end") is not None:
            return False
        last = self.modified(f"{number:09d}.beat") or self.modified(f"{number:09d}.run")
        return last is not None and self.now() - last <= patience


class Run:
    """What the work is given: its number, its tag, and check()."""

    def __init__(self, number: int, tag: str) -> None:
        self.number, self.tag, self.state = number, tag, RUNNING
        self.over = threading.Event()

    def check(self) -> None:
        """Raises Interrupted if the run must end."""
        if self.state in (STOPPED, LOST):
            raise Interrupted(f"run {self.number} is {self.state}")


def _watch(spark: SparkSession, files: _Folder, run: Run, cap: float, beat: float) -> None:
    started, beaten = dt.datetime.now().timestamp(), 0.0
    while not run.over.wait(min(beat, 0.5)):
        now = dt.datetime.now().timestamp()
        if run.state == RUNNING and now - started >= cap:
            run.state = STOPPED
        if now - beaten >= beat:
            beaten = now
            try:
                if max(files.numbers("run")) > run.number:
                    run.state = LOST
                else:
                    files.put(f"{run.number:09d}.beat", "")
            except Py4JJavaError:  # the store can't be reached: as if silent, the deadline holds all the same
                log.warning("run %d gave no sign of life", run.number, exc_info=True)
        if run.state != RUNNING:
            spark.sparkContext.cancelJobsWithTag(run.tag)


def scheduled(spark: SparkSession, folder: str, work: Callable[[Run], object], cap: float = CAP, patience: float = 120, beat: float = 20) -> str:
    """Does ``work`` unless another run is at it; ``done``, ``skipped``, ``stopped`` (over ``cap`` seconds) or ``lost`` (it was silent too long).

    Work that fails by itself fails here, and the lease is free again.  ``beat`` must be well below ``patience``.
    """
    if beat * 2 > patience:
        raise ValueError("a run must give several signs of life within patience")
    files = _Folder(spark, folder)
    taken = files.numbers("run")
    if taken and files.alive(taken[-1], patience):
        return SKIPPED
    number = taken[-1] + 1 if taken else 0
    name = f"{folder.rstrip('/')}/{number:09d}"
    run = Run(number, f"run-{uuid.uuid4().hex}")
    if not files.put_once(f"{name}.run", json.dumps({"tag": run.tag, "started": dt.datetime.now(dt.UTC).isoformat()})):
        return SKIPPED
    watch = threading.Thread(target=_watch, args=(spark, files, run, cap, beat), daemon=True)
    context = spark.sparkContext
    context.addJobTag(run.tag)
    watch.start()
    state = DONE
    try:
        work(run)
    except Exception:
        state = FAILED
        if run.state == RUNNING:
            raise
    finally:
        run.over.set()
        watch.join()
        context.removeJobTag(run.tag)
        state = run.state if run.state != RUNNING else state
        files.put_once(f"{name}.end", json.dumps({"state": state, "ended": dt.datetime.now(dt.UTC).isoformat()}))
    return state


def history(spark: SparkSession, folder: str) -> DataFrame:
    """(number, started, ended, state) of a folder's runs; those that haven't ended have a null end and are ``running``."""
    files, rows = _Folder(spark, folder), []
    ended = set(files.numbers("end"))
    for n in files.numbers("run"):
        name = f"{files.folder}/{n:09d}"
        end = json.loads(files.text(f"{name}.end")) if n in ended else {"state": RUNNING, "ended": None}
        rows.append((n, json.loads(files.text(f"{name}.run"))["started"], end["ended"], end["state"]))
    out = spark.createDataFrame(rows, "number long, started string, ended string, state string")
    return out.withColumns({c: out[c].cast("timestamp") for c in ("started", "ended")})
