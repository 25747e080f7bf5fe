"""Where intermediate results are kept, and jobs that run side by side."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from threading import Event, Thread
from time import monotonic
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

Result = TypeVar("Result")

# How many jobs of one run are submitted at a time. Independent jobs fill the slots that the last
# tasks of another leave idle.
JOBS_AT_A_TIME = 4


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder all executors can reach; on a single machine one is made if needed."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
            folder = tempfile.mkdtemp(prefix="plumbline-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own within the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Compute a small result once and keep it in the shared folder.

    What follows reads the stored result, so a lost executor never repeats the scan behind it.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def side_by_side(spark: SparkSession, jobs: Sequence[Callable[[], Result]]) -> list[Result]:
    """The results of independent jobs, in order."""
    if len(jobs) < 2:
        return [job() for job in jobs]
    with ThreadPoolExecutor(JOBS_AT_A_TIME) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
        return [job.result() for job in started]


#: Seconds between looks at whether a job with a time limit has tasks running.
LOOK_EVERY = 0.2


@contextmanager
def cancelled_after(spark: SparkSession, seconds: float | None) -> Iterator[None]:
    """Spark jobs that the block starts are cancelled once their tasks have run for that time; then the
    block ends in TimeoutError.

    Time in which they wait for others to free the executors does not count. Only jobs of the block are
    cancelled, told by a tag, so what runs beside it goes on.
    """
    if seconds is None:
        yield
        return
    if seconds <= 0:
        raise ValueError("a time limit is more than 0 seconds")
    context, tag = spark.sparkContext, f"plumbline-{uuid.uuid4().hex}"
    tracker = context._jsc.sc().statusTracker()
    known = context.statusTracker()
    done, late = Event(), Event()

    def has_tasks() -> bool:
        jobs = [known.getJobInfo(job) for job in tracker.getJobIdsForTag(tag)]
        stages = [known.getStageInfo(s) for job in jobs if job for s in job.stageIds]
        return any(stage is not None and stage.numActiveTasks > 0 for stage in stages)

    def watch() -> None:
        ran, looked = 0.0, monotonic()
        while not done.wait(LOOK_EVERY):
            now = monotonic()
            ran += now - looked if has_tasks() else 0.0
            looked = now
            if ran >= seconds:
                # Again each time, as the block may be between two jobs.
                late.set()
                context.cancelJobsWithTag(tag)

    context.addJobTag(tag)
    watcher = Thread(target=watch, daemon=True)
    watcher.start()
    try:
        yield
    except Exception as error:
        if late.is_set():
            raise TimeoutError(f"cancelled after {seconds:g} seconds") from error
        raise
    finally:
        done.set()
        watcher.join()
        context.removeJobTag(tag)
