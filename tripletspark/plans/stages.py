"""Ordered stages with tables between them."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tripletspark.session import stored
from tripletspark.sources.sinks import log_run


@dataclass(frozen=True)
class Stage:
    """``run`` maps the previous stage's table (None for the first) to this one's."""
    name: str
    run: Callable[[SparkSession, DataFrame | None], DataFrame]
    output: str


def has_output(spark: SparkSession, path: str) -> bool:
    """Whether something is stored in ``path``; an error that says anything else is raised."""
    return stored(spark, path) is not None


def run_stages(spark: SparkSession, stages: Sequence[Stage], *, only: str | None = None,
               log_path: str | None = None, run_id: str = "run",
               config: Mapping[str, object] | None = None, skip_existing: bool = True
               ) -> dict[str, str]:
    """Run all stages in order, or one. A stage whose output exists is skipped; each stage
    reads the previous stage's stored table and never overwrites its input. The outcome of
    every stage goes to the run log; the first failure ends the run."""
    if only is not None and only not in {s.name for s in stages}:
        raise ValueError(f"no stage {only!r}")
    status: dict[str, str] = {}
    before: str | None = None
    for stage in stages:
        previous, before = before, stage.output
        if only is not None and stage.name != only:
            continue
        if skip_existing and has_output(spark, stage.output):
            status[stage.name] = "skipped"
            continue
        started = time.monotonic()
        try:
            given = spark.read.parquet(previous) if previous else None
            stage.run(spark, given).write.mode("overwrite").parquet(stage.output)
            status[stage.name] = "ok"
        except Exception as e:
            status[stage.name] = f"failed: {e}"
            raise
        finally:
            if log_path:
                note = f"{stage.name}: {status[stage.name][:500]} " \
                       f"in {time.monotonic() - started:.1f}s"
                log_run(spark, log_path, {"run_id": run_id, "dataset_path": stage.output,
                                          "notes": note, **(config or {})})
    return status
