"""A time by which work is over: Spark jobs are cancelled then, and calls outside are no longer waited for."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import SparkSession


class Late(Exception):
    """The time is up."""


class Deadline:
    """seconds from now, or None for no limit."""

    def __init__(self, spark: SparkSession, seconds: float | None):
        self.context, self.seconds = spark.sparkContext, seconds
        self.end = None if seconds is None else time.monotonic() + seconds

    @property
    def left(self) -> float | None:
        return None if self.end is None else max(0.0, self.end - time.monotonic())

    @property
    def late(self) -> bool:
        return self.end is not None and time.monotonic() >= self.end

    @contextmanager
    def jobs(self) -> Iterator[None]:
        """Spark jobs of this thread, begun inside, end with the deadline; Late is raised then, and no job is left running."""
        if self.end is None:
            yield
            return
        if self.late:
            raise Late
        tag, over, cut = f"hayrick-{uuid.uuid4().hex}", threading.Event(), threading.Event()

        def watch() -> None:
            if over.wait(self.left):
                return
            cut.set()
            while True:  # a query may begin another job when one is cancelled
                self.context.cancelJobsWithTag(tag)
                if over.wait(0.05):
                    return

        self.context.addJobTag(tag)
        timer = threading.Thread(target=watch, daemon=True)
        timer.start()
        try:
            yield
        except Exception as e:
            if cut.is_set():
                raise Late from e
            raise
        finally:
            over.set()
            timer.join()
            self.context.removeJobTag(tag)

    def call(self, work: Callable[..., Any], *args: object) -> Any:
        """The result of a call outside of Spark; Late if it takes too long. A call that is late goes on by itself, and nothing comes of it."""
        if self.end is None:
            return work(*args)
        if self.late:
            raise Late
        out: list[tuple[bool, Any]] = []

        def run() -> None:
            try:
                out.append((True, work(*args)))
            except BaseException as e:  # it is raised where it is waited for
                out.append((False, e))

        thread = threading.Thread(target=run, daemon=True)
        thread.start()
        thread.join(self.left)
        if not out:
            raise Late
        good, value = out[0]
        if good:
            return value
        raise value
