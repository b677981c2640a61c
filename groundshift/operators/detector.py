"""A pluggable detector over tile pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from threading import local

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F, types as T

from .skew import shuffled

Detector = Callable[[dict], str]

CALLS_PER_TASK = 2048
IN_FLIGHT = 4
CALLS_PER_WAVE = 1_000_000
TASK_KEY = ["scene_id", "task_idx"]


def python_values(column: pa.Array) -> list:
    """Rows of an Arrow column as Python values; lists of numbers without nulls become numpy arrays over the same memory."""
    kind = column.type
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        sizes = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy()
        ends = np.cumsum(sizes, dtype=np.int64)
        items = column.flatten()
        number = pa.types.is_integer(items.type) or pa.types.is_floating(items.type)
        inner = items.to_numpy() if number and items.null_count == 0 else python_values(items)
        rows = [inner[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist())]
    elif pa.types.is_struct(kind):
        names = [f.name for f in kind]
        rows = [dict(zip(names, values)) for values in zip(*(python_values(f) for f in column.flatten()))] if names else [{}] * len(column)
    else:
        return column.to_pylist()
    return [v if there else None for v, there in zip(rows, column.is_valid().to_pylist())] if column.null_count else rows


def spread_calls(
    tasks: DataFrame, calls: int | None = None, calls_per_task: int = CALLS_PER_TASK, parallelism: int | None = None,
    keys: list[str] | None = None,
) -> DataFrame:
    """Deal rows so that a Spark task holds about ``calls_per_task`` of them, however few bytes they have.

    At least as many Spark tasks as the cluster has cores are used. ``calls``, the number of rows, is counted unless it is known;
    ``parallelism`` sets the number of Spark tasks instead. With ``keys``, which should tell rows apart, a recomputed task
    gets the same rows without a sort.
    """
    if parallelism is None:
        calls = tasks.count() if calls is None else calls
        parallelism = max(-(-calls // calls_per_task), min(calls, tasks.sparkSession.sparkContext.defaultParallelism), 1)
    return tasks.repartition(parallelism, *(keys or []))


def detect(
    tasks: DataFrame,
    make_detector: Callable[[], Detector],
    carry: list[str],
    parallelism: int | None = None,
    in_flight: int = IN_FLIGHT,
    calls: int | None = None,
    calls_per_task: int = CALLS_PER_TASK,
) -> DataFrame:
    """Call a detector once per row and return ``carry`` columns plus raw_text and error.

    ``make_detector`` runs once per thread and returns a callable from a row (as a dict) to the response text; lists of numbers
    arrive as numpy arrays. An exception becomes the row's ``error``; other rows are not affected. Rows are spread by
    their number (see ``spread_calls``), and each Spark task keeps up to ``in_flight`` calls going, so a detector that
    waits for a service does not idle a core. ``parallelism`` fixes the Spark tasks; parallelism times in_flight then bounds the calls
    in flight over the whole table. Filter before this operator: predicates do not move through it. Calls repeat when a task is retried or
    the result is read twice, so store the result (see ``plans.change_run``) or use ``detect_stored``.
    """
    kept = [tasks.schema[c] for c in carry]
    schema = T.StructType([
        *kept, T.StructField("raw_text", T.StringType()), T.StructField("error", T.StringType()),
    ])
    names = [f.name for f in schema.fields]

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = local()

        def attempt(row: dict) -> tuple[str | None, str | None]:
            try:
                if not hasattr(own, "detector"):
                    own.detector = make_detector()
                answer = own.detector(row)
                return None if answer is None else str(answer), None
            except Exception as problem:  # any failure of the callable belongs to its own row
                return None, str(problem)

        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                columns = [python_values(c) for c in batch.columns]
                rows = [dict(zip(batch.schema.names, values)) for values in zip(*columns)]
                answers: list = [None] * len(rows)
                # The threads take the next open row from one iterator, so a slow call holds up nothing but itself.
                open_rows = iter(range(len(rows)))

                def work() -> None:
                    for i in open_rows:
                        answers[i] = attempt(rows[i])

                if in_flight > 1 and len(rows) > 1:
                    for running in [pool.submit(work) for _ in range(min(in_flight, len(rows)))]:
                        running.result()
                else:
                    work()
                texts = [pa.array([a[i] for a in answers], pa.string()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), *texts], names=names)

    keys = [c for c in TASK_KEY if c in tasks.columns]
    return spread_calls(tasks, calls, calls_per_task, parallelism, keys if len(keys) == len(TASK_KEY) else None).mapInArrow(call, schema)


def stored_answers(tasks: DataFrame, carry: list[str], path: str) -> DataFrame:
    """The table of answers at ``path``: ``carry``, raw_text, error, attempt; an empty one is written where there is none."""
    fields = [*[tasks.schema[c] for c in carry], *[T.StructField(n, T.StringType()) for n in ("raw_text", "error")],
              T.StructField("attempt", T.IntegerType())]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    tasks.sparkSession.createDataFrame([], schema).write.mode("append").parquet(path)
    return tasks.sparkSession.read.schema(schema).parquet(path)


def detect_stored(
    tasks: DataFrame,
    make_detector: Callable[[], Detector],
    carry: list[str],
    path: str,
    retry_failed: bool = False,
    calls_per_wave: int = CALLS_PER_WAVE,
    retry: DataFrame | None = None,
    **options,
) -> DataFrame:
    """Answers of all tasks (scene_id, task_idx, ...), kept at ``path`` so that no stored call is ever repeated.

    Tasks with a stored answer are left out by an anti join; with ``retry_failed`` only an answer without an error counts, and the
    answers of tasks in ``retry`` (scene_id, task_idx) do not count. What is left is called in waves of about ``calls_per_wave`` rows, dealt by scene, and each wave is appended when it is done: a run
    that is killed loses the calls of its last wave only, and the next run goes on from there. Returns ``carry``, raw_text,
    error and attempt, the newest answer of every given task. ``carry`` must hold scene_id and task_idx; ``path`` must be shared
    by all executors, and one run at a time may write there. Other options are those of ``detect``.
    """
    spark = tasks.sparkSession
    known = stored_answers(tasks, carry, path)
    attempt = (known.agg(F.max("attempt")).first()[0] or 0) + 1
    done = known.where("error is null") if retry_failed else known
    done = done if retry is None else done.join(shuffled(retry.select(*TASK_KEY)), TASK_KEY, "left_anti")
    open_tasks = tasks.join(shuffled(done.select(*TASK_KEY).distinct()), TASK_KEY, "left_anti").select(*tasks.columns)
    calls = open_tasks.count()
    waves = -(-calls // calls_per_wave)
    for wave in range(waves):
        # Open tasks are those of this run's start: what earlier waves append has other scenes.
        part = open_tasks.where(F.pmod(F.xxhash64("scene_id", F.lit(7)), F.lit(waves)) == wave) if waves > 1 else open_tasks
        answers = detect(part, make_detector, carry, calls=-(-calls // waves), **options)
        answers.withColumn("attempt", F.lit(attempt)).write.mode("append").parquet(path)
    newest = newest_answers(spark.read.schema(known.schema).parquet(path))
    return newest.join(shuffled(tasks.select(*TASK_KEY)), TASK_KEY, "left_semi").select(*known.columns)


def newest_answers(answers: DataFrame) -> DataFrame:
    """The answer of the last attempt at every task."""
    others = [c for c in answers.columns if c not in TASK_KEY]
    return answers.groupBy(*TASK_KEY).agg(F.max_by(F.struct(*others), "attempt").alias("_a")).select(*TASK_KEY, "_a.*")
