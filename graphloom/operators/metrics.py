"""Figures of runs: throughput, latency, and memory series laid on phases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def latency(runs: DataFrame) -> DataFrame:
    """``(algorithm, executions, mean_ms)`` from ``(algorithm, micros)``: whole microseconds, then to milliseconds."""
    return runs.groupBy("algorithm").agg(F.count("*").alias("executions"), (F.floor(F.sum("micros") / F.count("*")) / 1000).alias("mean_ms"))


def throughput(ops: int, seconds: float) -> float:
    return ops / seconds if seconds else 0.0


def carry_marker(samples: DataFrame) -> DataFrame:
    """Each sample with the last marker at or before it, by series."""
    order = Window.partitionBy("series").orderBy("time").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return samples.withColumn("last_marker", F.last("marker", ignorenulls=True).over(order))


def phases(samples: DataFrame) -> DataFrame:
    """By series and last marker: when it began, how long it held, and its peak above the series' first value."""
    first = samples.groupBy("series").agg(F.min_by("value", "time").alias("baseline"))
    rows = carry_marker(samples).where("last_marker is not null").join(first, "series")
    return rows.groupBy("series", "last_marker").agg(F.min("time").alias("begin"), (F.max("time") - F.min("time")).alias("held"), F.max(F.col("value") - F.col("baseline")).alias("peak"))


def _interpolated(rows: DataFrame, points: int) -> DataFrame:
    """``(series, step, value)`` at ``points`` + 1 even steps of ``p`` from 0 to 1, by lines between neighbouring rows of
    ``(series, p, value)``; no value beyond a series' own ends."""
    order = Window.partitionBy("series").orderBy("p")
    parts = rows.withColumn("q", F.lead("p").over(order)).withColumn("next", F.lead("value").over(order)).where("q > p")
    steps = F.sequence(F.ceil(F.col("p") * points), F.ceil(F.col("q") * points))
    line = F.col("value") + (F.col("next") - F.col("value")) * (F.col("k") / points - F.col("p")) / (F.col("q") - F.col("p"))
    held = (F.col("k") / points >= F.col("p")) & ((F.col("k") / points < F.col("q")) | ((F.col("q") == 1) & (F.col("k") == points)))
    return parts.withColumn("k", F.explode(steps)).where(held).select("series", F.col("k").alias("step"), line.alias("value"))


def on_grid(samples: DataFrame, points: int) -> DataFrame:
    """Each series at ``points`` + 1 even steps of its progress from 0 to 1, by lines between neighbouring samples."""
    ends = samples.groupBy("series").agg(F.min("time").alias("t0"), F.max("time").alias("t1"))
    rows = samples.join(ends, "series").where("t1 > t0").withColumn("p", (F.col("time") - F.col("t0")) / (F.col("t1") - F.col("t0")))
    return _interpolated(rows.select("series", "p", "value"), points)


def mark_lines(lines: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """``(…, marker)``: the name of the first pattern that a log line matches; lines that match none are left out."""
    first = F.coalesce(*(F.when(F.col("line").rlike(p), F.lit(name)) for name, p in patterns.items()))
    return lines.withColumn("marker", first).where("marker is not null")


def marker_times(events: DataFrame) -> DataFrame:
    """``(series, marker, time)``: when each marker was first seen."""
    return events.where("marker is not null").groupBy("series", "marker").agg(F.min("time").alias("time"))


def memory_peaks(samples: DataFrame) -> DataFrame:
    """By series: samples, how long they span, and the peaks of resident memory and of its high-water mark, in MB."""
    peak = lambda c: (F.max(c) / 1024).alias(f"peak_{c[:-3]}_mb")
    return samples.groupBy("series").agg(F.count("*").alias("samples"), (F.max("time") - F.min("time")).alias("duration"), peak("rss_kb"), peak("hwm_kb"))


def _two_phases(samples: DataFrame, events: DataFrame, marks: tuple[str, str, str, str, str]) -> DataFrame:
    """``(series, time, value, phase, t0, t1, baseline)``: samples of the two phases with their bounds; a sample on a
    bound that both share is in both. ``marks``: baseline, begin and end of the first phase, and of the second."""
    at = [F.min(F.when(F.col("marker") == m, F.col("time"))).alias(x) for m, x in zip(marks, ("tb", "a0", "a1", "b0", "b1"))]
    times = marker_times(events).groupBy("series").agg(*at)
    rows = samples.select("series", "time", "value").join(times, "series")
    after = F.min(F.when(F.col("time") >= F.col("tb"), F.struct("time", "value")))["value"]
    base = rows.groupBy("series").agg(F.coalesce(after, F.min_by("value", "time")).alias("baseline"))
    phase = F.explode(F.array(*(F.struct(F.lit(i).alias("phase"), F.col(f"{x}0").alias("t0"), F.col(f"{x}1").alias("t1")) for i, x in ((1, "a"), (2, "b")))))
    rows = rows.select("series", "time", "value", phase.alias("x")).select("series", "time", "value", "x.*").where("time between t0 and t1")
    return rows.join(base, "series")


def phase_curve(samples: DataFrame, events: DataFrame, marks: tuple[str, str, str, str, str], split: float = 0.10, points: tuple[int, int] = (80, 320)) -> DataFrame:
    """``(series, phase, step, x, value)``: growth over the baseline in two phases laid end to end on [0, 1].

    The first phase takes ``split`` of the axis and so many points, the second the rest; before a phase's first sample
    and after its last the curve is level. Phases of under two samples have no curve.
    """
    rows = _two_phases(samples, events, marks)
    p = F.when(F.col("t1") > F.col("t0"), (F.col("time") - F.col("t0")) / (F.col("t1") - F.col("t0"))).otherwise(0.0)
    rows = rows.select(F.struct("series", "phase").alias("series"), p.alias("p"), (F.col("value") - F.col("baseline")).alias("value"))
    ends = rows.groupBy("series").agg(F.count("*").alias("n"), F.min_by("value", "p").alias("first"), F.max_by("value", "p").alias("last"), F.min("p").alias("lo"), F.max("p").alias("hi")).where("n > 1")
    rows = rows.join(ends.select("series"), "series", "left_semi")
    level = ends.where("lo > 0").select("series", F.lit(0.0), "first").union(ends.where("hi < 1").select("series", F.lit(1.0), "last"))
    out = None
    for i, (n, start, width) in enumerate(((points[0], 0.0, split), (points[1], split, 1.0 - split)), 1):
        one = _interpolated(rows.union(level).where(F.col("series.phase") == i), n - 1)
        one = one.select("series.series", "series.phase", "step", (start + width * F.col("step") / (n - 1)).alias("x"), "value")
        out = one if out is None else out.union(one)
    return out


def phase_report(samples: DataFrame, events: DataFrame, marks: tuple[str, str, str, str, str]) -> DataFrame:
    """By series: memory at the baseline, at the end of the first phase and at the peak of the second, the growth of
    both over the baseline, and how long the phases took."""
    rows = _two_phases(samples, events, marks)
    one, two = F.col("phase") == 1, F.col("phase") == 2
    got = rows.groupBy("series").agg(
        F.min("baseline").alias("baseline"), F.max_by(F.when(one, F.col("value")), F.when(one, F.col("time"))).alias("first_end"), F.max(F.when(two, F.col("value"))).alias("second_peak"),
        F.max(F.when(one, F.col("t1") - F.col("t0"))).alias("first_held"), F.max(F.when(two, F.col("t1") - F.col("t0"))).alias("second_held"),
    )
    return got.select("*", (F.col("first_end") - F.col("baseline")).alias("first_growth"), (F.col("second_peak") - F.col("baseline")).alias("second_growth"), (F.col("first_held") + F.col("second_held")).alias("held"))


#: What became of a run.
STATUSES = ("ok", "unsupported", "unsupported-directed", "load-finalize-failed", "algorithm-failed", "result-unavailable")


def result_line(algorithm: str, repetition: int, root: object, load_ms: float, processing_ms: float, status: str = "ok", reason: str = "", edge_mode: str = "undirected", system: str = "graphloom") -> str:
    """One line of figures for a run, in the form that benchmark harnesses parse."""
    if status not in STATUSES:
        raise ValueError(f"unknown status {status}")
    times = " ".join(f"{k}_ms={v:.1f}" for k, v in (("load", load_ms), ("processing", processing_ms), ("makespan", load_ms + processing_ms)))
    return f"GRAPHALYTICS_RESULT system={system} algorithm={algorithm} repetition={repetition} root={root} edge_mode={edge_mode} {times} status={status}" + (f" reason={reason}" if reason else "")


def result_path(base: str, algorithm: str, repetition: int, n_algorithms: int, repetitions: int) -> str:
    """Where a run's result goes: the algorithm and the repetition are told apart only where there are several."""
    return base + (f".{algorithm}" if n_algorithms > 1 else "") + (f".rep{repetition}" if repetitions > 1 else "")
