import math
import time
import zlib

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from graphloom.functions.hashing import duration, mix
from graphloom.operators import kernels, log as mlog, metrics, reads, workload
from graphloom.operators.components import components
from graphloom.operators.graph import Graph
from graphloom.operators.ranking import first_rows, ranked
from graphloom.plans.staging import stage_bucketed
from graphloom.sources import files
from graphloom.streaming.concurrent import Heartbeat, Progress, run_concurrently
from graphloom.streaming.ingest import ingest, live_edges, read_operations

EDGES = [(0, 1, 4.0), (0, 2, 1.0), (1, 2, 2.0), (1, 3, 5.0), (1, 4, 1.0), (10, 11, 3.0)]


@pytest.fixture(scope="module")
def hand(spark):
    v = spark.createDataFrame([(x,) for x in (0, 1, 2, 3, 4, 10, 11, 20)], "id long")
    return Graph.from_edges(spark.createDataFrame(EDGES, "src long, dst long, weight double"), v)


def pairs(df):
    return {r[0]: r[1] for r in df.collect()}


def test_kernels_on_hand_graph(hand):
    assert pairs(hand.degrees()) == {0: 2, 1: 4, 2: 2, 3: 1, 4: 1, 10: 1, 11: 1, 20: 0}
    ranks = pairs(kernels.pagerank(hand))
    want = {0: 0.136799128, 1: 0.267295210, 2: 0.136799128, 3: 0.079203617, 4: 0.079203617, 10: 0.139860140, 11: 0.139860140, 20: 0.020979021}
    assert all(abs(ranks[k] - x) < 1e-8 for k, x in want.items()) and abs(sum(ranks.values()) - 1) < 1e-9
    assert pairs(kernels.bfs(hand, 0)) == {0: 0, 1: 1, 2: 1, 3: 2, 4: 2, 10: -1, 11: -1, 20: -1}
    assert pairs(kernels.sssp(hand, 0)) == {0: 0, 1: 3, 2: 1, 3: 8, 4: 4, 10: math.inf, 11: math.inf, 20: math.inf}
    assert pairs(kernels.wcc(hand)) == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 10: 10, 11: 10, 20: 20}
    assert pairs(kernels.lcc(hand))[1] == pytest.approx(1 / 6) and pairs(kernels.lcc(hand))[0] == 1
    assert pairs(kernels.cdlp(hand)) == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 10: 10, 11: 11, 20: 20}
    assert kernels.triangle_count(hand).first()[0] == 1
    with pytest.raises(ValueError):
        kernels.bfs(hand, 99)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "src long, dst long")
    got = pairs(components(edges))
    assert {got[i] for i in range(61)} == {0} and got[101] == 100 and 7 in got
    assert components(edges.limit(0)).count() == 0


def test_transactions(spark):
    store = mlog.MutationLog(spark)
    a = store.begin()
    a.upsert(1, 2, 1.0)
    a.upsert(2, 3, 2.0)
    assert a.edges().count() == 2 and mlog.snapshot(store.log).count() == 0
    b = store.begin()
    b.delete(1, 2)
    a.commit()
    with pytest.raises(mlog.TransactionConflict):
        b.commit()
    with pytest.raises(mlog.TransactionClosed):
        a.upsert(1, 2, 3.0)
    with pytest.raises(mlog.TransactionClosed):
        store.begin(read_only=True).delete(1, 2)
    store.retry(lambda t: t.delete(2, 1))
    assert [(r.lo, r.hi) for r in mlog.snapshot(store.log).collect()] == [(2, 3)]
    assert mlog.snapshot(store.log, 2).count() == 2
    assert {r.id for r in mlog.graph_at(store.log).vertices.collect()} == {1, 2, 3}


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(ops=st.lists(st.tuples(st.sampled_from("UUD"), st.integers(0, 5), st.integers(0, 5), st.integers(0, 9)), min_size=1, max_size=40), cut=st.integers(1, 40))
def test_log_against_a_dictionary(spark, ops, cut):
    log = spark.createDataFrame([(i + 1, o, a, b, float(w)) for i, (o, a, b, w) in enumerate(ops)], mlog.MutationLog.SCHEMA)

    def model(n):
        live = {}
        for o, a, b, w in ops[:n]:
            if a != b:
                live.pop((min(a, b), max(a, b)), None)
                if o == "U":
                    live[min(a, b), max(a, b)] = float(w)
        return live

    found = lambda frame, n: {(r.lo, r.hi): r.weight for r in mlog.snapshot(frame, n).collect()}
    assert found(log, cut) == model(cut)
    assert found(mlog.compact(log, cut), cut) == model(cut) and found(mlog.compact(log, cut), None) == model(len(ops))


def test_sources(spark, tmp_path):
    (tmp_path / "g.e").write_text("1 2 0.5\n2 3\n\n3 1 7 extra\n")
    rows = files.edge_list(spark, str(tmp_path / "g.e"), ordered=True).orderBy("seq").collect()
    assert [(r.src, r.dst, r.weight) for r in rows] == [(1, 2, 0.5), (2, 3, 0.0), (3, 1, 7.0)]
    assert files.edge_list(spark, str(tmp_path / "g.e"), limit=2).count() == 2
    (tmp_path / "bad.e").write_text("1 2\nx\n")
    assert files.edge_list(spark, str(tmp_path / "bad.e"), strict=False).count() == 1
    with pytest.raises(Exception, match="invalid edge record"):
        files.edge_list(spark, str(tmp_path / "bad.e")).collect()
    src, dst, w = np.array([1, 2, 3], "<i8"), np.array([2, 3, 4], "<i8"), np.array([1.0, -1.0, 2.5], "<f8")
    body = b""
    for a, b in ((0, 2), (2, 3)):
        z = zlib.compressobj(wbits=-15)
        body += z.compress(src[a:b].tobytes() + dst[a:b].tobytes() + w[a:b].tobytes()) + z.flush()
    (tmp_path / "x.log").write_bytes(b"# GRAPHLOG\ninternal.edges.block_size = 2\ninternal.edges.cardinality = 3\n__BINARY_SECTION_FOLLOWS" + body)
    got = files.graph_log(spark, str(tmp_path / "x.log")).orderBy("seq").collect()
    assert [(r.op, r.src, r.dst, r.weight) for r in got] == [("U", 1, 2, 1.0), ("D", 2, 3, -1.0), ("U", 3, 4, 2.5)]
    hot = spark.createDataFrame([(1, 2, 0.25)], "src long, dst long, weight double")
    files.write_hot_set(hot, str(tmp_path / "hot"), fraction=0.1)
    assert files.hot_set(spark, str(tmp_path / "hot")).collect() == hot.collect()
    (tmp_path / "c.csv").write_text("# c\n9,4,1\n4,4,1\n4,7\n")
    edges = files.delimited_edges(spark, str(tmp_path / "c.csv"))
    assert edges.count() == 2 and pairs(files.dense_remap(edges)) == {4: 0, 9: 1, 7: 2}
    files.write_result(spark.createDataFrame([(2, 0.5), (1, math.inf)], "id long, value double"), str(tmp_path / "r"), "value")
    assert [r.value for r in spark.read.text(str(tmp_path / "r")).orderBy("value").collect()] == ["1 inf", "2 0.5"]


def test_workloads(spark, hand):
    assert int(mix(np.array([0], np.uint64))[0]) == 0xE220A8397B1DCDAF
    edges = spark.range(40).selectExpr("id src", "id + 100 dst", "1.0D weight")
    idm = workload.mixed_round(edges, "idm", 42, 1)
    assert idm.groupBy("action").count().orderBy("action").collect() == [("MODIFY", 20), ("REINSERT", 10)] and idm.select("src").distinct().count() == 30
    assert workload.hot_plan(10, 20) == (4, 2)
    with pytest.raises(ValueError):
        workload.hot_plan(10, 30)
    assert workload.hot_edges(edges, 0.1, 1).count() == 4
    assert workload.affine_positions(spark, 9, 10, 3, 4).select("position").distinct().count() == 9
    with pytest.raises(ValueError):
        workload.hot_rounds(0)


def test_stream_equals_batch(spark, tmp_path):
    ops = spark.createDataFrame([(i, "D" if i % 4 == 0 else "U", i % 5, i % 7 + 1, float(i)) for i in range(1, 41)], mlog.MutationLog.SCHEMA)
    for k in range(4):
        ops.where(f"seq > {10 * k} and seq <= {10 * k + 10}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = {}
    q = ingest(read_operations(spark, str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "cp"), lambda g, e: seen.update({e: g.edges.count()}))
    q.awaitTermination()
    assert len(seen) == 4 and seen[3] == mlog.snapshot(ops).count()


def test_lines_keep_their_order_over_splits(spark, tmp_path):
    (tmp_path / "big.e").write_text("".join(f"{i} {i + 1}\n" for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = files.edge_list(spark, str(tmp_path / "big.e"), ordered=True)
        assert [(r.seq, r.src) for r in rows.orderBy("seq").collect()] == [(i, i) for i in range(2000)]
        assert sorted(r.src for r in files.edge_list(spark, str(tmp_path / "big.e"), limit=700).collect()) == list(range(700))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_command_line(spark, tmp_path):
    from graphloom.__main__ import arguments, run

    (tmp_path / "g.e").write_text("".join(f"{a} {b} {w}\n" for a, b, w in EDGES))
    base = ["--file", str(tmp_path / "g.e"), "--output", str(tmp_path / "out")]
    lines = run(spark, arguments().parse_args([*base, "--algorithm", "bfs,nope", "--root", "1", "--repetitions", "2"]))
    assert len(lines) == 4 and "algorithm=bfs repetition=2 root=1 edge_mode=undirected" in lines[1] and lines[1].endswith("status=ok")
    assert lines[2].endswith("status=unsupported reason=unknown-algorithm")
    got = {r.value for r in spark.read.text(str(tmp_path / "out.bfs.rep1")).collect()}
    assert got == {"0 1", "1 0", "2 1", "3 1", "4 1", "10 -1", "11 -1"}
    assert "status=algorithm-failed" in run(spark, arguments().parse_args([*base, "--algorithm", "sssp", "--root", "77"]))[0]
    assert "status=unsupported-directed" in run(spark, arguments().parse_args([*base, "--algorithm", "pr", "--edge-mode", "directed"]))[0]
    with pytest.raises(ValueError):
        files.preset(spark, "nothing")


def test_commits_stay_readable_when_staged(spark):
    store = mlog.MutationLog(spark)
    for i in range(2 * store.STAGE_AFTER + 3):
        store.append([("U", i, i + 1, float(i))])
    assert store.version == mlog.snapshot(store.log).count() == 2 * store.STAGE_AFTER + 3
    assert mlog.backoff(3) == 0 and mlog.backoff(17) == 2e-6 and mlog.backoff(99) == 1e-6 * 1024


def test_versions_of_vertices_labels_and_epochs(spark, hand):
    ask = spark.createDataFrame([(1,), (5,), (5,)], "id long")
    assert pairs(mlog.insert_vertices(hand, ask)) == {1: False, 5: True}
    assert [r.id for r in mlog.new_vertices(hand, 2).collect()] == [21, 22]
    epochs = lambda xs: mlog.published_epoch(spark.createDataFrame([(x,) for x in xs], "epoch long")).first()[0]
    assert epochs([0, 1, 2, 4]) == 2 and epochs([1, 2]) == -1 and epochs([]) == -1 and epochs([3, 0]) == 0
    log = spark.createDataFrame([(1, "U", 1, 1, 2, "a"), (2, "U", 1, 2, 2, "b"), (3, "D", 1, 1, 2, None)], "seq long, op string, src long, label int, dst long, payload string")
    assert [(r.label, r.payload) for r in mlog.labelled_snapshot(log).collect()] == [(2, "b")] and mlog.labelled_snapshot(log, 2).count() == 2
    g = hand.publish()
    assert pairs(g.vertex_ids(spark.createDataFrame([(0,), (7,), (8,)], "logical_id long"))) == {0: 0, 7: 20, 8: None}
    rows, seen = reads.counted(hand.edges, F.col("weight") > 2)
    rows.collect()
    assert seen.get == {"records": 6, "visible": 3}


def test_streams(spark):
    star = Graph.from_edges(spark.createDataFrame([(0, i, 1.0) for i in range(1, 200)], "src long, dst long, weight double"))
    for weighted, least in ((True, 30), (False, 0)):
        got = workload.drawn_stream(star, 100, 5, weighted)
        n = got.where("part = 'insert'").count()
        assert got.count() == 199 and least <= n <= 100
    places = workload.shuffled(star.edges, 3, "hi", by=("lo",)).select("place")
    assert sorted(r.place for r in places.collect()) == list(range(199))
    again = workload.checksum(star.edges, "lo", "hi").first()
    assert again == workload.checksum(star.edges.orderBy("hi"), "lo", "hi").first() and again.n == 199
    for plan, g in workload.churn_rounds(Graph.from_edges(spark.createDataFrame([(i, i + 1, float(i)) for i in range(30)], "src long, dst long, weight double")), 2, 4):
        assert plan.count() == g.edges.distinct().count() == 30 and plan.where("new_dst is null").isEmpty()


def test_memory_series(spark, tmp_path):
    rows = [(float(t), 1024 * t, float(t), 2048 * t, 2.0 * t, 0, 0.0, None) for t in range(1, 11)]
    files.write_csv(spark.createDataFrame(rows, files.SAMPLES), str(tmp_path / "mem"))
    mem = files.memory_samples(spark, str(tmp_path / "mem")).withColumn("series", F.lit(1))
    peaks = metrics.memory_peaks(mem.withColumnRenamed("time_sec", "time")).first()
    assert (peaks.samples, peaks.duration, peaks.peak_rss_mb, peaks.peak_hwm_mb) == (10, 9.0, 10.0, 20.0)
    lines = spark.createDataFrame([(1, 2.0, "load starts"), (1, 5.0, "load done"), (1, 6.0, "load done"), (1, 9.0, "bye"), (1, 1.0, "?")], "series int, time double, line string")
    events = metrics.mark_lines(lines, {"a": "starts$", "b": "done", "c": "^bye"})
    samples = mem.select("series", F.col("time_sec").alias("time"), F.col("rss_mb").alias("value"))
    report = metrics.phase_report(samples, events, ("a", "a", "b", "b", "c")).first()
    assert (report.baseline, report.first_end, report.second_peak, report.held) == (2.0, 5.0, 9.0, 7.0)
    curve = metrics.phase_curve(samples, events, ("a", "a", "b", "b", "c"), points=(4, 5)).orderBy("x", "phase").collect()
    assert [round(r.value, 9) for r in curve] == [0, 1, 2, 3, 3, 4, 5, 6, 7] and curve[-1].x == 1.0
    with pytest.raises(ValueError):
        metrics.result_line("pr", 1, 0, 0, 0, status="odd")


def test_kernels_over_the_whole_table(spark, tmp_path):
    import heapq
    import random
    from collections import Counter

    from graphloom.plans.fixtures import copurchase
    from graphloom.plans.queries import QUERIES

    rnd, lines, weight = random.Random(3), [], {}
    for order in range(30):
        base = 1 if order < 20 else 31  # two components at least
        picks = [(k, base + rnd.randrange(20), float(rnd.randrange(1, 51))) for k in range(1, rnd.randrange(2, 5))]
        lines += [(order, *x) for x in picks]
        for (_, a, q), (_, b, _) in zip(picks, picks[1:]):
            if a != b:
                weight[min(a, b), max(a, b)] = min(q, weight.get((min(a, b), max(a, b)), q))
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    adj = {}
    for (a, b), w in weight.items():
        adj.setdefault(a, {})[b] = adj.setdefault(b, {})[a] = w
    ids = sorted(adj)

    def far(root, cost):
        dist, work = {}, [(0, root)]
        while work:
            d, v = heapq.heappop(work)
            if v not in dist:
                dist[v] = d
                for u, w in adj[v].items():
                    heapq.heappush(work, (d + cost(w), u))
        return dist

    got = {name: [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()] for name in ("degree", "pagerank", "bfs", "sssp_weighted", "sssp_unit", "wcc", "cdlp")}
    g = copurchase(spark, str(tmp_path))
    got["logical_ids"], got["has_vertex_probe"] = g.logical_ids().collect(), reads.has_vertex(g, spark.range(1, 60)).collect()
    got["component_sizes"] = [tuple(r) for r in kernels.component_numbers(kernels.wcc(g)).collect()]
    unit, root = far(ids[0], lambda w: 1), ids[0]
    assert dict(got["degree"]) == {v: len(adj[v]) for v in ids} and dict(got["logical_ids"]) == {v: i for i, v in enumerate(ids)}
    assert dict(got["has_vertex_probe"]) == {v: v in adj for v in range(1, 60)}
    assert dict(got["bfs"]) == {v: unit.get(v, -1) for v in ids} and {v: d for v, there, d in got["sssp_unit"] if there} == unit
    assert {v: d for v, there, d in got["sssp_weighted"]} == {v: far(root, lambda w: w).get(v) for v in ids}
    component = {v: min(far(v, lambda w: 1)) for v in ids}
    sizes = sorted(Counter(component.values()).items())
    assert dict(got["wcc"]) == component and sorted(got["component_sizes"]) == [(i, c, n) for i, (c, n) in enumerate(sizes)] and len(sizes) > 1
    rank, label = dict.fromkeys(ids, 1 / len(ids)), {v: v for v in ids}
    for _ in range(10):
        rank = {v: 0.15 / len(ids) + 0.85 * sum(rank[u] / len(adj[u]) for u in adj[v]) for v in ids}
        label = {v: min(Counter(label[u] for u in adj[v]).items(), key=lambda x: (-x[1], x[0]))[0] for v in ids}
    assert all(abs(r - rank[v]) < 1e-8 for v, r in got["pagerank"]) and dict(got["cdlp"]) == label


def test_edges_conflict_at_both_ends(spark):
    for a, b in (((3, 5), (5, 3)), ((3, 5), (9, 3)), ((3, 5), (5, 9))):
        store = mlog.MutationLog(spark)
        one, two = store.begin(), store.begin()
        one.upsert(*a, 1.0)
        two.upsert(*b, 2.0)
        one.commit()
        with pytest.raises(mlog.TransactionConflict):
            two.commit()
    store = mlog.MutationLog(spark)
    one, two = store.begin(), store.begin()
    one.upsert(1, 2, 1.0)
    two.upsert(3, 4, 1.0)
    assert one.commit() == 1 and two.commit() == 2


def test_negative_edges_end(spark):
    edges = spark.createDataFrame([(1, 2, -1.0), (2, 3, 4.0)], "src long, dst long, weight double")
    got = pairs(kernels.sssp(Graph.from_edges(edges), 1))
    want = {1: 0.0, 2: math.inf, 3: math.inf}
    for _ in range(2):  # as many rounds as vertices less one
        want = {v: min([want[v]] + [want[u] + w for a, b, w in ((1, 2, -1.0), (2, 3, 4.0)) for u, x in ((a, b), (b, a)) if x == v]) for v in want}
    assert got == want


def test_durations_round_seconds(spark):
    made = {0.04: "0.0s", 59.96: "60.0s", 60.2: "1m", 65.7: "1m 6s", 119.7: "1m 60s", 3599.0: "59m 59s", 3600.0: "1h 0m", 7322.0: "2h 2m"}
    rows = spark.createDataFrame([(x,) for x in made], "x double").select("x", duration("x").alias("shown"))
    assert {r.x: r.shown for r in rows.collect()} == made


def test_ranks_and_first_rows(spark):
    rows = spark.range(3000).selectExpr("id * 1000003 % 3001 id", "id % 7 k").repartition(5)
    want = sorted((r.k, r.id) for r in rows.collect())
    got = {(r.k, r.id): r.place for r in ranked(rows, "k", "id").collect()}
    assert [got[x] for x in want] == list(range(3000))
    assert sorted((r.k, r.id) for r in first_rows(rows, 1234, F.desc("k"), "id").collect()) == sorted(sorted(want, key=lambda x: (-x[0], x[1]))[:1234])
    far = Graph(spark.createDataFrame([(x,) for x in (5, 1 << 62, -7, 1 << 40, 0)], "id long"), None)
    assert pairs(far.logical_ids()) == {-7: 0, 0: 1, 5: 2, 1 << 40: 3, 1 << 62: 4}


def test_graph_log_round_trip(spark, tmp_path):
    rows = spark.range(5000).selectExpr("if(id % 5 = 0, 'D', 'U') op", "id src", "id * 7 dst", "cast(id as double) weight").coalesce(1)
    content = files.encode_graph_log(rows, block=700).collect()[0].content
    (tmp_path / "x.log").write_bytes(bytes(content))
    got = files.graph_log(spark, str(tmp_path / "x.log")).collect()
    assert [(r.seq, r.op, r.src, r.dst) for r in sorted(got, key=lambda r: r.seq)] == [(i, "D" if i % 5 == 0 else "U", i, 7 * i) for i in range(5000)]
    (tmp_path / "cut.log").write_bytes(bytes(content)[:-9])
    with pytest.raises(Exception, match="ends within a block"):
        files.graph_log(spark, str(tmp_path / "cut.log")).collect()


def test_checksums_tell_orders_apart(spark):
    rows = spark.range(300).selectExpr("id at", "id % 17 src", "id % 23 dst")

    def plain(order, seed=5, chunk=100):
        one = lambda h, xs: [h := int(mix(np.array([(h ^ x) & (1 << 64) - 1], np.uint64))[0]) for x in xs][-1]
        keys = [(i % 17) ^ (i % 23) << 32 for i in order]
        digests = [one((seed + c) & (1 << 64) - 1, keys[c * chunk : (c + 1) * chunk]) for c in range(-(-len(keys) // chunk))]
        return one(seed, digests)

    got = workload.chained_checksum(rows, 5, "at", chunk=100).first()
    assert (got.n, got.digest % (1 << 64)) == (300, plain(range(300)))
    back = workload.chained_checksum(rows, 5, F.desc("at"), chunk=100).first()
    assert back.digest % (1 << 64) == plain(range(299, -1, -1)) != got.digest % (1 << 64)
    assert workload.chained_checksum(rows.where("at < 0"), 5, "at").first().n == 0
    plan = rows.selectExpr("src", "at + 100 dst", "at + 1000 new_dst")
    one, two = (workload.churn_digests(plan.repartition(n), 3).first() for n in (1, 4))
    assert one == two and one.operations != workload.churn_digests(plan.where("new_dst > 1000"), 3).first().operations


def test_heartbeat_and_stall(tmp_path):
    said, stalled = [], []
    progress = Progress(started={"pr": 1}, runs=[("pr", 5, 1)])
    with Heartbeat(progress, every=0.02, idle=3, emit=said.append, path=str(tmp_path / "p"), on_stall=lambda: stalled.append(1)):
        while not stalled:
            time.sleep(0.01)
    assert said[0].startswith("[Heartbeat] ops done: 0 rate: 0") and any(x.startswith("[STALL] no progress for 0.06s, ops=0") for x in said)
    assert (tmp_path / "p").read_text().splitlines()[1] == "TASK 0 algo=pr started=1 completed=1 elapsed_us=5"


def test_readers_start_after_the_first_batch_and_run_until_writes_end(spark):
    store, seen = mlog.MutationLog(spark), []
    batch = lambda k: spark.createDataFrame([("U", 10 * k + i, i + 1 + 10 * k, 1.0, i) for i in range(5)], "op string, src long, dst long, weight double, seq long")

    def degrees(g):
        seen.append(g.edges.count())
        return g.degrees()

    progress = run_concurrently(store, (batch(k) for k in range(4)), {"degrees": degrees})
    assert store.version == 20 and progress.ops == 20 and len(progress.runs) == len(seen) >= 1
    assert all(n and n % 5 == 0 for n in seen) and all(v % 5 == 0 and v for _, _, v in progress.runs)
    with pytest.raises(RuntimeError):
        run_concurrently(store, [batch(9)], {"bad": lambda g: (_ for _ in ()).throw(RuntimeError("no"))})


def test_stateful_upserts(spark, tmp_path):
    ops = spark.createDataFrame([(i, "D" if i % 4 == 0 else "U", i % 5, i % 7 + 1, float(i)) for i in range(1, 41)], mlog.MutationLog.SCHEMA)
    for k in range(4):
        ops.where(f"seq > {10 * k} and seq <= {10 * k + 10}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = live_edges(read_operations(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("live").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.lo, r.hi, r.weight) for r in spark.table("live").where("op = 'U'").collect()}
    assert got == {(r.lo, r.hi, r.weight) for r in mlog.snapshot(ops).collect()} == {(r.lo, r.hi, r.weight) for r in live_edges(ops).where("op = 'U'").collect()}


def test_command_line_writes(spark, tmp_path, capsys):
    from graphloom.__main__ import arguments, check, run

    (tmp_path / "g.e").write_text("".join(f"{a} {b} {w}\n" for a, b, w in EDGES))
    go = lambda *more: run(spark, check(arguments(), arguments().parse_args(["--file", str(tmp_path / "g.e"), *more])))
    assert go("--mix", "id", "--rounds", "2")[1].startswith("MIX kind=id round=2 reinserts=3 modifies=0 operations=6")
    assert go("--churn", "--rounds", "1")[0].startswith("CHURN round=1 edges=6")
    assert go("--hotset", "0.5", "--hotset-update-pct", "100", "--rounds", "1")[0].startswith("HOTSET round=1 hot=3 reinserts=0 updates=3 operations=3")
    lines = go("--con", "--tasks", "wcc,bfs", "--batches", "2", "--repeat", "2", "--quiet", "--progress-file", str(tmp_path / "p"))
    assert lines[0].startswith("WRITER operations=12") and [x.split()[1] for x in lines[1:]] == ["algorithm=bfs", "algorithm=wcc"]
    assert (tmp_path / "p").read_text().startswith("PROGRESS")
    for bad in (["--hotset", "0.5", "--mix", "id"], ["--mix", "id", "--repeat", "2"], ["--hotset", "2"]):
        with pytest.raises(SystemExit):
            go(*bad)


def test_tail_rule_bulk_load_and_multi_edges(spark, hand, tmp_path):
    n = hand.vertices.agg(F.max("id")).first()[0]
    wide = Graph(hand.vertices.union(spark.createDataFrame([(n + 1,), (n + 2,)], "id long")), hand.edges)
    ids = spark.createDataFrame([(n,), (n + 1,), (n + 2,), (999,)], "id long")
    assert pairs(mlog.remove_tail(wide, ids)) == {n: False, n + 1: False, n + 2: True, 999: False}
    store = mlog.MutationLog(spark)
    assert store.bulk_load(hand.edges.selectExpr("lo src", "hi dst", "weight")) == store.version == hand.edges.count() == mlog.snapshot(store.log).count()
    rows = [(1, "U", 1, 0, 2, 1.0), (2, "U", 1, 0, 2, 2.0), (3, "D", 1, 0, 2, None), (4, "U", 1, 0, 2, 3.0), (5, "U", 1, 0, 2, 4.0), (6, "U", 1, 1, 2, 5.0)]
    put = spark.createDataFrame(rows, "seq long, op string, src long, label int, dst long, payload double")
    assert sorted(r.payload for r in mlog.put_edges(put, force_insert=True).collect()) == [3.0, 4.0, 5.0]
    assert sorted(r.payload for r in mlog.put_edges(put, 2, force_insert=True).collect()) == [1.0, 2.0]
    assert sorted(r.payload for r in mlog.put_edges(put).collect()) == [4.0, 5.0]
    samples = spark.createDataFrame([(0.5, 1024, 1.0, 2048, 2.0, 1, 1.0, "a"), (2.5, 4096, 4.0, 4096, 4.0, 1, 1.0, "b")], files.SAMPLES)
    events = spark.createDataFrame([(1.0, "load", "x")], files.EVENTS)
    files.write_memory_summary(samples, events, str(tmp_path / "m"), "one")
    got = spark.read.json(str(tmp_path / "m")).first()
    assert (got.label, got.duration_sec, got.peak_rss_kb, got.peak_hwm_mb, got.samples, got.events[0].marker) == ("one", 2.5, 4096, 4.0, 2, "load")


def test_bucketed_tables_are_not_shuffled_again(spark):
    edges = stage_bucketed(spark.range(4000).selectExpr("id % 97 src", "id dst"), "src")
    assert edges.count() == 4000
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = edges.join(spark.range(97).withColumnRenamed("id", "src").withColumn("rank", F.lit(1.0)), "src")
        assert joined.count() == 4000
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        assert pairs(kernels.pagerank(Graph.from_edges(spark.createDataFrame([(1, 2)], "src long, dst long")), 3)) == {1: 0.5, 2: 0.5}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_components_with_hubs(spark, monkeypatch):
    from graphloom.operators import components as module

    monkeypatch.setattr(module, "HUB_LINKS", 20)
    monkeypatch.setattr(module, "HUBS", 10)
    rng = np.random.default_rng(4)
    made = [(0 if i % 3 == 0 else 1000 + int(rng.integers(0, 40)), int(rng.integers(1, 900))) for i in range(500)] + [(5000 + i, 6000) for i in range(99)] + [(7000, 7001)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in made:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert pairs(components(spark.createDataFrame(made, "src long, dst long"))) == {x: find(x) for x in list(root)}
