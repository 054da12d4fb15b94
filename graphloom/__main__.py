"""Command line: load a graph, run kernels on it, or write to it in rounds, with readers beside.

    python -m graphloom --file edges.e --algorithm pr,bfs --root 1 --output out
    python -m graphloom --file edges.e --mix idm --rounds 3 --wseed 7
    python -m graphloom --file edges.e --con --tasks pr,wcc --repeat 2 --progress-file progress.txt
"""

from __future__ import annotations

import argparse
import os
import signal
import time
from math import ceil

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.operators import kernels, log as mlog, metrics, workload
from graphloom.operators.graph import Graph
from graphloom.operators.metrics import result_line, result_path
from graphloom.sources.files import PRESETS, edge_list, graph_log, hot_set, write_result
from graphloom.streaming.concurrent import Heartbeat, Progress, run_concurrently


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    source = p.add_mutually_exclusive_group(required=True)
    source.add_argument("--file", help="edge list: src dst [weight] a line")
    source.add_argument("--prefile", choices=sorted(PRESETS) or None, help="short name of a dataset")
    source.add_argument("--graphlog", help="binary graph log, replayed before anything else")
    p.add_argument("--edge-limit", type=int, default=0, help="lines to read, 0 for all")
    p.add_argument("--edge-mode", choices=("undirected", "directed"), default="undirected")
    p.add_argument("--permute", action="store_true", help="write edges in seeded order, not in that of the file")
    p.add_argument("--graphalytics", action="store_true", help="run kernels (what is done if nothing else is asked for)")
    p.add_argument("--common-algorithms", action="store_true", help="the shared kernels; there are no others here")
    p.add_argument("--algorithm", default="all", help="all, or names from " + ", ".join(kernels.KERNELS))
    p.add_argument("--root", type=int, help="of bfs and sssp; the smallest id if left out")
    p.add_argument("--repetitions", type=int, default=1)
    p.add_argument("--pr-iterations", type=int, default=10)
    p.add_argument("--damping", type=float, default=0.85)
    p.add_argument("--cdlp-iterations", type=int, default=10)
    p.add_argument("--output", help="folder for results; algorithm and repetition are added where there are several")
    p.add_argument("--no-collect-results", action="store_true", help="write no results")
    p.add_argument("--mix", choices=sorted(workload.MIXES), help="rounds of reinserts and modifications")
    p.add_argument("--rounds", type=int, help="of writes; 1 if left out, for hot sets as many as their share asks for")
    p.add_argument("--wseed", type=int, default=42, help="seed of writes")
    p.add_argument("--hotset", type=float, help="share of the edges that rounds write to")
    p.add_argument("--hotset-file", help="the hot set itself")
    p.add_argument("--hotset-update-pct", type=int, default=0, choices=(0, 20, 40, 60, 80, 100))
    p.add_argument("--churn", action="store_true", help="replace every edge in each round")
    p.add_argument("--split-update", action="store_true", help="write updates as a delete and an insert")
    p.add_argument("--repeat", type=int, default=1, help="times that all edges are written, directions in turn")
    p.add_argument("--con", action="store_true", help="read while edges are written")
    p.add_argument("--tasks", default="pr", help="kernels that read, by comma")
    p.add_argument("--batches", type=int, default=8, help="of a pass of writes")
    p.add_argument("--read-thread", type=int, default=0, help="taken for other programs' sake: executors decide")
    p.add_argument("--write-thread", type=int, default=0, help="taken for other programs' sake: executors decide")
    p.add_argument("--reference-schedule", action="store_true", help="taken for other programs' sake: rounds are seeded here")
    p.add_argument("--progress-file", help="where the counters go every ten seconds")
    p.add_argument("--stall-abort", action="store_true", help="abort when no write succeeds for two minutes")
    loud = p.add_mutually_exclusive_group()
    loud.add_argument("--quiet", action="store_true")
    loud.add_argument("--verbose", action="store_true")
    return p


def check(p: argparse.ArgumentParser, args: argparse.Namespace) -> argparse.Namespace:
    """What can't go together is an error."""
    hot = args.hotset is not None or args.hotset_file
    for on, other, names in ((hot, args.mix, "--hotset and --mix"), (hot, args.repeat > 1, "--hotset and --repeat"), (args.mix, args.repeat > 1, "--mix and --repeat"),
                             (args.churn, args.mix or hot, "--churn and --mix or --hotset"), (args.hotset is not None, args.hotset_file, "--hotset and --hotset-file")):
        if on and other:
            p.error(f"{names} exclude each other")
    if args.hotset is not None and not 0 < args.hotset <= 1:
        p.error("--hotset must be over 0 and 1 at most")
    return args


def load(spark: SparkSession, args: argparse.Namespace) -> Graph:
    if args.graphlog:
        return mlog.graph_at(graph_log(spark, args.graphlog)).publish()
    return Graph.from_edges(edge_list(spark, args.file or PRESETS[args.prefile], limit=args.edge_limit)).publish()


def run_kernels(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    """Load once, run every kernel so many times; a kernel that fails gives its status and the others go on."""
    begin = time.time()
    g = load(spark, args)
    root = kernels.default_root(g) if args.root is None else args.root
    load_ms = 1000 * (time.time() - begin)
    names = list(kernels.KERNELS) if args.algorithm == "all" else args.algorithm.split(",")
    given = {"pr": {"iterations": args.pr_iterations, "damping": args.damping}, "cdlp": {"rounds": args.cdlp_iterations}, "bfs": {"root": root}, "sssp": {"root": root}}
    lines = []
    for name in names:
        for turn in range(1, args.repetitions + 1):
            status, reason, begin = "ok", "", time.time()
            if args.edge_mode == "directed":
                status, reason = "unsupported-directed", "edges-are-undirected"
            elif name not in kernels.KERNELS:
                status, reason = "unsupported", "unknown-algorithm"
            else:
                try:
                    out = kernels.KERNELS[name](g, **given.get(name, {}))
                    if args.output and not args.no_collect_results and name != "tc":
                        write_result(out, result_path(args.output, name, turn, len(names), args.repetitions), out.columns[1])
                    else:
                        out.write.format("noop").mode("overwrite").save()
                except ValueError as e:
                    status, reason = "algorithm-failed", str(e).replace(" ", "-")
            shown = root if name in ("bfs", "sssp") else "-"
            lines.append(result_line(name, turn, shown, load_ms, 1000 * (time.time() - begin), status, reason, args.edge_mode))
    return lines


def _ops(edges: DataFrame, split: bool) -> DataFrame:
    """Edges with ``seq`` as upserts, or each as a delete and an upsert."""
    return workload.split_updates(edges) if split else edges.withColumn("op", F.lit("U"))


def _timed(store: mlog.MutationLog, ops: DataFrame, what: str) -> str:
    before, begin = store.version, time.time()
    store.extend(ops)
    took = time.time() - begin
    return f"{what} operations={store.version - before} seconds={took:.1f} rate={metrics.throughput(store.version - before, took):.0f}"


def run_writes(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    """Rounds of writes on the loaded graph, each a batch of the log; a line of figures for each."""
    g = load(spark, args)
    store, edges, lines = mlog.MutationLog(spark), g.edges.select(F.col("lo").alias("src"), F.col("hi").alias("dst"), "weight"), []
    store.bulk_load(edges)
    if args.churn:
        for r, (plan, now) in enumerate(workload.churn_rounds(g, args.rounds or 1, args.wseed), 1):
            d = workload.churn_digests(plan, args.wseed + r).first()
            lines.append(f"CHURN round={r} edges={now.edges.count()} replaced={d['n']} operation_checksum={d['operations']} order_checksum={d['ordered']}")
        return lines
    if args.mix:
        for r in range(1, (args.rounds or 1) + 1):
            rows = workload.mixed_round(edges, args.mix, args.wseed, r)
            stats = workload.round_stats(rows).first()
            ops = workload.shuffled(rows, args.wseed + r, "src", "dst").withColumnRenamed("place", "seq")
            again = workload.split_updates(ops.where("action = 'REINSERT'"))
            changed = (workload.split_updates(x) if args.split_update else x.select((F.col("seq") * 2).alias("seq"), F.lit("U").alias("op"), "src", "dst", "weight") for x in [ops.where("action = 'MODIFY'")])
            rows = workload.ranked(again.unionByName(next(changed)).withColumnRenamed("seq", "at"), "at", name="seq").drop("at")
            lines.append(_timed(store, rows, f"MIX kind={args.mix} round={r} reinserts={stats['reinserts']} modifies={stats['modifies']}"))
        return lines
    hot = hot_set(spark, args.hotset_file) if args.hotset_file else workload.hot_edges(edges, args.hotset, args.wseed).select("src", "dst", "weight")
    size = hot.count()
    share = args.hotset or size / max(1, edges.count())
    again, updates = workload.hot_plan(size, args.hotset_update_pct)
    for r in range(1, (args.rounds or workload.hot_rounds(min(1.0, share))) + 1):
        one = workload.shuffled(hot, args.wseed + r, "src", "dst").where(F.col("place") < again).withColumnRenamed("place", "seq")
        two = workload.hot_updates(hot, updates, args.wseed + r)
        ops = workload.split_updates(one).unionByName(_ops(two, args.split_update).withColumn("seq", F.col("seq") + 2 * again).select("seq", "op", "src", "dst", "weight"))
        lines.append(_timed(store, workload.ranked(ops.withColumnRenamed("seq", "at"), "at", "op", name="seq").drop("at"), f"HOTSET round={r} hot={size} reinserts={again} updates={updates}"))
    return lines


def run_beside(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    """Edges written in batches, and again if asked for, while kernels read; mean latencies at the end."""
    g = load(spark, args)
    root = kernels.default_root(g) if args.root is None else args.root
    edges = g.edges.select(F.col("lo").alias("src"), F.col("hi").alias("dst"), "weight")
    order = workload.shuffled(edges, args.wseed, "src", "dst") if args.permute else workload.ranked(edges, "src", "dst")
    turned = order.select("place", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    total = edges.count()
    size = max(1, ceil(total / args.batches))

    def batches():
        for turn in range(args.repeat):
            for at in range(0, total, size):
                rows = (turned if turn % 2 else order).where((F.col("place") >= at) & (F.col("place") < at + size))
                yield _ops(rows.withColumn("seq", F.col("place") - at), args.split_update)

    names = args.tasks.split(",")
    first = lambda g: root if root is not None else kernels.default_root(g)

    def work(name: str, now: Graph) -> DataFrame:
        if name in ("bfs", "sssp"):  # a root that is not written yet is a vertex by itself
            seen = now.vertices.union(spark.createDataFrame([(first(g),)], "id long")).distinct()
            return kernels.KERNELS[name](Graph(seen, now.edges), first(g))
        return kernels.KERNELS[name](now)

    progress = Progress()
    emit = (lambda x: None) if args.quiet else print
    stall = (lambda: os.kill(os.getpid(), signal.SIGABRT)) if args.stall_abort else None
    with Heartbeat(progress, emit=emit, path=args.progress_file, on_stall=stall):
        store = mlog.MutationLog(spark)
        run_concurrently(store, batches(), {f"{n}": (lambda now, n=n: work(n, now)) for n in names}, progress)
    runs = spark.createDataFrame([(n, us) for n, us, _ in progress.runs], "algorithm string, micros long")
    took = time.time() - progress.begin
    lines = [f"WRITER operations={progress.ops} seconds={took:.1f} rate={metrics.throughput(progress.ops, took):.0f}"]
    return lines + [f"READER algorithm={r['algorithm']} executions={r['executions']} mean_ms={r['mean_ms']:.1f}" for r in metrics.latency(runs).orderBy("algorithm").collect()]


def run(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    if args.con:
        return run_beside(spark, args)
    if args.mix or args.churn or args.hotset is not None or args.hotset_file:
        return run_writes(spark, args)
    return run_kernels(spark, args)


if __name__ == "__main__":
    parser = arguments()
    options = check(parser, parser.parse_args())
    session = SparkSession.builder.appName("graphloom").getOrCreate()
    session.sparkContext.setLogLevel("INFO" if options.verbose else "ERROR")
    print("\n".join(run(session, options)))
