"""Watching and stopping what a request has started: steps of a process, whose jobs carry its tag."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ..operators import exports
from ..runtime import discard, shared_dir, written
from ..sources import sinks
from ..sources.dataset import Dataset
from .execution import chart, selected_variants
from .requests import ChartRequest, SearchRequest


class Aborted(RuntimeError):
    """The process was stopped by its user."""


@dataclass
class Process:
    """A user's process: the step that it is in, of which steps, and whether it was stopped, failed or is done.

    Any thread may ask for its state or stop it; the thread that runs it does its jobs within `step`.
    """

    spark: SparkSession
    token: str = field(default_factory=lambda: uuid.uuid4().hex)
    steps: list[str] = field(default_factory=list)
    current: int = -1
    done: bool = False
    error: str | None = None
    _stop: threading.Event = field(default_factory=threading.Event)

    @property
    def tag(self) -> str:
        return f"allelix-{self.token}"

    @property
    def aborted(self) -> bool:
        return self._stop.is_set()

    def abort(self) -> None:
        """Stop the process: its running jobs are cancelled, and its next step doesn't begin."""
        self._stop.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    @contextmanager
    def step(self, name: str) -> Iterator[None]:
        """Jobs that this thread starts within belong to the process. What fails because of a stop is raised as Aborted."""
        context = self.spark.sparkContext
        if self.aborted:
            raise Aborted(self.token)
        if name not in self.steps:
            self.steps.append(name)
        self.current = self.steps.index(name)
        context.addJobTag(self.tag)
        try:
            yield
        except Exception as error:
            if self.aborted:
                raise Aborted(self.token) from error
            self.error = f"{name}: {type(error).__name__}: {error}"
            raise
        finally:
            context.removeJobTag(self.tag)
        if self.aborted:
            raise Aborted(self.token)

    def share(self) -> float:
        """The share of the steps that are behind."""
        return 1.0 if self.done else max(0, self.current) / max(1, len(self.steps))

    def state(self) -> str:
        """What a user is told."""
        if self.aborted:
            return "aborted"
        if self.error:
            return f"failed: {self.error}"
        if self.done:
            return "done"
        return f"step {self.current + 1} of {len(self.steps)}: {self.steps[self.current]}" if self.current >= 0 else "waiting"


def run_chart(process: Process, data: Dataset, request: ChartRequest, statistic: str, samples: bool = False) -> list[tuple]:
    """The rows of a chart (as many as it has windows), in steps: finding variants, then their statistics."""
    process.steps = ["Finding variants", f"Computing {statistic}"]
    with process.step(process.steps[0]):
        # where genotypes decide, the variants are found once and written
        selected = written(selected_variants(data, request, samples), "selection") if request.filters_genotypes and data.packed is None else None
    with process.step(process.steps[1]):
        rows = [tuple(r) for r in chart(data, request, statistic, samples, selected).orderBy("bin_start").collect()]
    process.done = True
    return rows


def run_export(process: Process, data: Dataset, format: str, request: SearchRequest, folder: str, name: str = "export", samples: bool = False) -> dict[str, str]:
    """The files of an export, each as ordered parts below the folder; by extension, where they are.

    Steps: finding variants, preparing (what a format computes for several files), and each file. Whatever ends the
    process early, the folder's new files go, and so does what was written on the way.
    """
    process.steps = ["Finding variants", "Preparing files"]
    spark, scratch = process.spark, f"{shared_dir(process.spark)}/process-{process.token}"
    out: dict[str, str] = {}
    try:
        with process.step(process.steps[0]):
            selected_variants(data, request, samples).write.parquet(f"{scratch}/variants")
        with process.step(process.steps[1]):
            files = exports.export(data, format, request, samples, selected=spark.read.parquet(f"{scratch}/variants"))
        process.steps += [f"Writing {kind}" for kind in files]
        for kind, df in files.items():
            with process.step(f"Writing {kind}"):
                out |= sinks.write_export_parts({kind: df}, folder, name)
        process.done = True
        return out
    except BaseException:
        for kind in files if "files" in locals() else ():
            sinks.remove(sinks.place_of(folder, name, kind))
        raise
    finally:
        discard(spark, scratch)


@contextmanager
def job_group(spark: SparkSession, name: str, what: str) -> Iterator[None]:
    """Jobs that this thread starts within belong to the group; those that still run when it is left by an error are stopped."""
    context = spark.sparkContext
    context.setJobGroup(name, what, interruptOnCancel=True)
    try:
        yield
    except BaseException:
        context.cancelJobGroup(name)
        raise
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        context.setLocalProperty("spark.job.description", None)


def progress(spark: SparkSession, name: str) -> float:
    """The share of a group's tasks, in stages begun so far, that are done."""
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(name)]
    stages = [tracker.getStageInfo(s) for j in jobs if j is not None for s in j.stageIds]
    known = [s for s in stages if s is not None]
    tasks = sum(s.numTasks for s in known)
    return sum(s.numCompletedTasks for s in known) / tasks if tasks else 0.0


def abort(spark: SparkSession, name: str) -> None:
    spark.sparkContext.cancelJobGroup(name)
