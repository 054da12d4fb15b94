"""Writers and readers at once: kernels run again and again on the latest snapshot while batches of writes arrive."""

from __future__ import annotations

import os
import threading
import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from graphloom.operators.graph import Graph
from graphloom.operators.log import MutationLog, graph_at


# The lines of a heartbeat and of the counters, as programs that read them expect.
BEAT = "[Heartbeat] ops done: {ops} rate: {rate} ops/s"
STALL = "[STALL] no progress for {seconds:g}s, ops={ops}"
PROGRESS = "PROGRESS elapsed_ms={elapsed:.0f} writer_ops={ops} num_tasks={tasks}"
TASK = "TASK {i} algo={name} started={started} completed={completed} elapsed_us={micros}"


@dataclass
class Progress:
    """What a run has done so far; threads add to it."""

    begin: float = field(default_factory=time.time)
    ops: int = 0
    started: dict[str, int] = field(default_factory=dict)
    runs: list[tuple[str, int, int]] = field(default_factory=list)

    def frame(self) -> str:
        """The counters as text, a line for the writer and one for each reader."""
        lines = [PROGRESS.format(elapsed=1000 * (time.time() - self.begin), ops=self.ops, tasks=len(self.started))]
        for i, (name, started) in enumerate(list(self.started.items())):
            own = [us for n, us, _ in list(self.runs) if n == name]
            lines.append(TASK.format(i=i, name=name, started=started, completed=len(own), micros=sum(own)))
        return "\n".join(lines) + "\n"


class Heartbeat:
    """A thread that says every so often how many operations are done, and that a run has stalled after ``idle`` times
    without any; the counters also go to ``path``, replaced as a whole each time."""

    def __init__(self, progress: Progress, every: float = 10.0, idle: int = 12, emit: Callable[[str], None] = print, path: str | None = None, on_stall: Callable[[], None] | None = None) -> None:
        self.progress, self.every, self.idle, self.emit, self.path, self.on_stall = progress, every, idle, emit, path, on_stall
        self.done = threading.Event()
        self.thread = threading.Thread(target=self._run, daemon=True)

    def _run(self) -> None:
        last, still = self.progress.ops, 0
        while not self.done.wait(self.every):
            now = self.progress.ops
            still = still + 1 if now == last else 0
            self.emit(BEAT.format(ops=now, rate=int((now - last) / self.every)))
            self._write()
            if still >= self.idle:
                self.emit(STALL.format(seconds=self.every * self.idle, ops=now))
                still = 0
                if self.on_stall:
                    self.on_stall()
            last = now

    def _write(self) -> None:
        if self.path:
            with open(self.path + ".new", "w", encoding="utf-8") as f:
                f.write(self.progress.frame())
            os.replace(self.path + ".new", self.path)

    def __enter__(self) -> Heartbeat:
        self.thread.start()
        return self

    def __exit__(self, *_) -> None:
        self.done.set()
        self.thread.join()
        self._write()


def run_concurrently(store: MutationLog, batches: Iterable[DataFrame], readers: dict[str, Callable[[Graph], DataFrame]], progress: Progress | None = None, least_runs: int = 1) -> Progress:
    """Append ``batches(op, src, dst, weight, seq)`` while every reader computes on the latest published version.

    Readers are released once the first batch is in, and start again until the writer has ended, ``least_runs`` times at
    least; each run sees one version from beginning to end. ``runs`` holds (reader, microseconds, version). What fails in
    any thread fails the run.
    """
    progress = progress or Progress()
    released, ended = threading.Event(), threading.Event()

    def write() -> None:
        try:
            for batch in batches:
                before = store.version
                store.extend(batch)
                progress.ops += store.version - before
                released.set()
        finally:
            ended.set()
            released.set()

    def read(name: str, work: Callable[[Graph], DataFrame]) -> None:
        released.wait()
        n = 0
        while n < least_runs or not ended.is_set():
            progress.started[name] = progress.started.get(name, 0) + 1
            with store.lock:
                log, version = store.log, store.version
            begin = time.time()
            work(graph_at(log, version)).write.format("noop").mode("overwrite").save()
            progress.runs.append((name, int(1e6 * (time.time() - begin)), version))
            n += 1

    for name in readers:
        progress.started[name] = 0
    with ThreadPoolExecutor(1 + len(readers)) as pool:
        for done in [pool.submit(write), *(pool.submit(read, *x) for x in readers.items())]:
            done.result()
    return progress
