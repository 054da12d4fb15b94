"""The engine's operators as queries over the test tables, and their SQL counterparts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.functions.hashing import duration, edge_key, edge_rank, mix, mix64
from graphloom.operators import kernels, log as mlog, metrics, reads, workload
from graphloom.operators.graph import Graph
from graphloom.plans.fixtures import LOG, PLACED_SQL, UND, copurchase, hash_sql, log, mix_sql, placed, snap_sql, table, written
from graphloom.plans.staging import shared_dir
from graphloom.sources import files
from graphloom.sources.files import dense_remap
from graphloom.streaming.ingest import window_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


CO, PLACED = f"with recursive {UND}", f"with recursive {PLACED_SQL}"
SNAP = f"with recursive {snap_sql()}"
EARLY = f"with recursive {snap_sql('5000')}"


def _snap(s: SparkSession, d: str, version: int | None = None) -> Graph:
    return mlog.graph_at(log(s, d), version)


def _parts(s: SparkSession, d: str) -> DataFrame:
    """Every part id: probes, of which some are no vertices."""
    return table(s, d, "part").select(F.col("p_partkey").alias("id"))


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").where("l_partkey <> l_suppkey").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()


PAIRS = "pairs as (select distinct l_partkey src, l_suppkey dst from lineitem where l_partkey <> l_suppkey)"

# Reads

query("degree", f"{CO} select id, degree from deg")(lambda s, d: copurchase(s, d).degrees())
query("degree_histogram", f"{CO} select degree, count(*) n from deg group by 1")(lambda s, d: copurchase(s, d).degrees().groupBy("degree").agg(F.count("*").alias("n")))
query("num_vertices_edges", f"{SNAP} select (select count(*) from v) vertices, (select count(*) from und) edges")(
    lambda s, d: _snap(s, d).vertices.agg(F.count("*").alias("vertices")).crossJoin(_snap(s, d).edges.agg(F.count("*").alias("edges")))
)
query("logical_ids", f"{PLACED} select id, row_number() over (order by id) - 1 logical_id from v")(lambda s, d: placed(s, d).logical_ids())
query("has_vertex_probe", f"{PLACED} select p_partkey id, p_partkey in (select id from v) found from part")(lambda s, d: reads.has_vertex(placed(s, d), _parts(s, d)))
query("has_edge_probe", f"{CO}, {PAIRS} select src, dst, und.lo is not null found from pairs left join und on least(src, dst) = lo and greatest(src, dst) = hi")(
    lambda s, d: reads.get_edges(copurchase(s, d), _pairs(s, d)).select("src", "dst", "found")
)
query("get_weight_probe", f"{CO}, {PAIRS} select src, dst, und.weight from pairs left join und on least(src, dst) = lo and greatest(src, dst) = hi")(
    lambda s, d: reads.get_edges(copurchase(s, d), _pairs(s, d)).select("src", "dst", F.col("found_weight").alias("weight"))
)
query("has_weighted_edge_probe", f"{CO}, {PAIRS} select src, dst, coalesce(und.weight = 1, false) found from pairs left join und on least(src, dst) = lo and greatest(src, dst) = hi")(
    lambda s, d: reads.get_edges(copurchase(s, d), _pairs(s, d)).select("src", "dst", F.coalesce(F.col("found_weight") == 1, F.lit(False)).alias("found"))
)
query("scan_neighbors_sum", f"{CO} select src id, count(*) n, sum(dst)::bigint dst_sum, round(sum(weight), 6) weight_sum from adj join part on src = p_partkey group by 1")(
    lambda s, d: reads.neighbors(copurchase(s, d), _parts(s, d)).groupBy("id").agg(F.count("*").alias("n"), F.sum("dst").alias("dst_sum"), F.round(F.sum("weight"), 6).alias("weight_sum"))
)
query("neighbors_sorted", f"{CO} select src id, string_agg(dst::varchar, ',' order by dst) neighbors from adj join part on src = p_partkey group by 1")(
    lambda s, d: reads.sorted_neighbors(copurchase(s, d), _parts(s, d)).select("id", F.array_join(F.transform("neighbors", lambda x: x.cast("string")), ",").alias("neighbors"))
)
query("neighbors_until", f"{CO} select src id, min(case when weight >= 10 and dst > 100 then dst end) is not null stopped, min(case when weight >= 10 and dst > 100 then dst end) \"first\" from adj join part on src = p_partkey group by 1")(
    lambda s, d: reads.until(copurchase(s, d), _parts(s, d), (F.col("weight") >= 10) & (F.col("dst") > 100))
)
query(
    "neighbor_intersection",
    f"{CO} select lo a, hi b, (select count(*) from adj x join adj y on x.dst = y.dst where x.src = lo and y.src = hi) common from und",
)(lambda s, d: reads.intersections(copurchase(s, d), copurchase(s, d).edges.select(F.col("lo").alias("a"), F.col("hi").alias("b"))))
query("edges_newest_first", f"{SNAP} select lo, hi, row_number() over (partition by lo order by seq desc) place from und")(
    lambda s, d: mlog.snapshot(log(s, d)).selectExpr("lo", "hi", "row_number() over (partition by lo order by seq desc) place")
)
query("aggregate_neighbors", f"{CO} select dst id, max(degree) \"value\" from adj join deg on deg.id = src group by 1")(
    lambda s, d: reads.aggregate_neighbors(copurchase(s, d), copurchase(s, d).degrees(), F.col("degree"), F.max("message"))
)
query("microbench_scan", f"{CO} select count(*) valid_sum, sum(dst)::bigint \"sum\" from adj join part on src = p_partkey")(
    lambda s, d: reads.neighbors(copurchase(s, d), _parts(s, d)).agg(F.count("*").alias("valid_sum"), F.sum("dst").alias("sum"))
)
query("microbench_get_edge", f"{CO}, {PAIRS} select count(*) probes, count(und.lo) valid_sum from pairs left join und on least(src, dst) = lo and greatest(src, dst) = hi")(
    lambda s, d: reads.get_edges(copurchase(s, d), _pairs(s, d)).agg(F.count("*").alias("probes"), F.count(F.when(F.col("found"), 1)).alias("valid_sum"))
)

query("vertex_ids", f"{CO}, r as (select id, row_number() over (order by id) - 1 logical_id from v) select p_partkey logical_id, id from part left join r on logical_id = p_partkey")(
    lambda s, d: copurchase(s, d).vertex_ids(_parts(s, d).select(F.col("id").alias("logical_id")))
)
query("neighbor_lists", f"{CO} select src id, string_agg(dst || ':' || weight::int, ',' order by dst) neighbors from adj join part on src = p_partkey group by 1")(
    lambda s, d: reads.neighbor_lists(copurchase(s, d), _parts(s, d)).select("id", F.array_join(F.transform("neighbors", lambda x: F.concat(x.dst.cast("string"), F.lit(":"), x.weight.cast("int").cast("string"))), ",").alias("neighbors"))
)
query("intersection_lists", f"{CO} select lo a, hi b, x.dst from und join adj x on x.src = lo join adj y on y.src = hi and y.dst = x.dst")(
    lambda s, d: reads.intersection_lists(copurchase(s, d), copurchase(s, d).edges.select(F.col("lo").alias("a"), F.col("hi").alias("b")))
)
query("default_root", f"{CO} select min(id) root from v")(lambda s, d: copurchase(s, d).vertices.agg(F.min("id").alias("root")))

# Kernels


def pagerank_sql(head: str, rounds: int = 10, d: float = 0.85) -> str:
    steps = ["r0 as materialized (select id, degree, 1.0::double / (select count(*) from v) as pr from deg)"]
    for i in range(rounds):
        steps.append(
            f"r{i + 1} as materialized (select r.id, r.degree, (1 - {d}::double) / (select count(*) from v) + {d}::double * (coalesce(s.got, 0) + (select coalesce(sum(pr), 0) from r{i} where degree = 0) / (select count(*) from v)) pr "
            f"from r{i} r left join (select adj.dst id, sum(q.pr / q.degree) got from adj join r{i} q on q.id = adj.src group by 1) s on s.id = r.id)"
        )
    return f"{head}, {', '.join(steps)} select id, round(pr, 9) \"rank\" from r{rounds}"


def bfs_sql(head: str, root: str = "(select min(id) from v)") -> str:
    steps = f"reach(id, level) as (select {root}, 0 union select adj.dst, level + 1 from reach join adj on adj.src = reach.id where level < 40)"
    return f"{head}, {steps} select v.id, coalesce(min(level), -1)::int level from v left join reach on v.id = reach.id group by 1"


def sssp_sql(head: str, weight: str, rounds: int, root: str = "(select min(id) from v)") -> str:
    steps = [f"d0 as materialized (select id, case when id = {root} then 0.0::double end distance from v)"]
    for i in range(rounds):
        steps.append(f"d{i + 1} as materialized (select d.id, least(d.distance, s.offer) distance from d{i} d left join (select adj.dst id, min(q.distance + {weight}) offer from adj join d{i} q on q.id = adj.src group by 1) s on s.id = d.id)")
    return f"{head}, {', '.join(steps)} select id, distance is not null reached, round(distance, 6) distance from d{rounds}"


def cdlp_sql(head: str, rounds: int = 10) -> str:
    steps = ["l0 as materialized (select id, id label from v)"]
    for i in range(rounds):
        steps.append(
            f"l{i + 1} as materialized (select l.id, coalesce(b.label, l.label) label from l{i} l left join (select src, label from (select src, label, row_number() over (partition by src order by count(*) desc, label) k from adj join l{i} q on q.id = adj.dst group by 1, 2) where k = 1) b on b.src = l.id)"
        )
    return f"{head}, {', '.join(steps)} select id, label from l{rounds}"


def wcc_sql(head: str, columns: str, end: str = "", rounds: int = 20) -> str:
    """Least ids spread for more rounds than any shortest path of these graphs is long."""
    steps = ["c0 as materialized (select id, id component from v)"]
    for i in range(rounds):
        steps.append(f"c{i + 1} as materialized (select c.id, least(c.component, s.least_id) component from c{i} c left join (select adj.dst id, min(q.component) least_id from adj join c{i} q on q.id = adj.src group by 1) s on s.id = c.id)")
    return f"{head}, {', '.join(steps)} select {columns} from c{rounds} {end}"


TRI = ", tri as (select a.lo x, a.hi y, b.hi z from und a join und b on a.hi = b.lo join und c on c.lo = a.lo and c.hi = b.hi), corner as (select x id from tri union all select y from tri union all select z from tri), t as (select id, count(*) triangles from corner group by 1)"


CUSTOMER_ROOT = "(select 2 * min(o_custkey) from orders)"


def _root(g: Graph) -> int:
    return kernels.default_root(g)


def _customer_root(s: SparkSession, d: str) -> int:
    return 2 * table(s, d, "orders").agg(F.min("o_custkey")).first()[0]


@query("pagerank", pagerank_sql(CO))
def pagerank(s: SparkSession, d: str) -> DataFrame:
    return kernels.pagerank(copurchase(s, d)).select("id", F.round("rank", 9).alias("rank"))


@query("pagerank_dangling", pagerank_sql(PLACED))
def pagerank_dangling(s: SparkSession, d: str) -> DataFrame:
    return kernels.pagerank(placed(s, d)).select("id", F.round("rank", 9).alias("rank"))


query("pagerank_at_snapshot", pagerank_sql(EARLY))(lambda s, d: kernels.pagerank(_snap(s, d, 5000)).select("id", F.round("rank", 9).alias("rank")))


def _distances(found: DataFrame) -> DataFrame:
    """Distances, infinite ones as a flag and no number."""
    reached = F.col("distance") < float("inf")
    return found.select("id", reached.alias("reached"), F.when(reached, F.round("distance", 6)).alias("distance"))


query("bfs", bfs_sql(CO))(lambda s, d: kernels.bfs(g := copurchase(s, d), _root(g)))
query("bfs_at_snapshot", bfs_sql(EARLY))(lambda s, d: kernels.bfs(g := _snap(s, d, 5000), _root(g)))
query("bfs_unreached", bfs_sql(PLACED, CUSTOMER_ROOT))(lambda s, d: kernels.bfs(g := placed(s, d), _customer_root(s, d)))
query("sssp_weighted", sssp_sql(CO, "adj.weight", 30))(lambda s, d: _distances(kernels.sssp(g := copurchase(s, d), _root(g))))
query("sssp_unit", sssp_sql(CO, "1", 30))(lambda s, d: _distances(kernels.sssp(g := copurchase(s, d), _root(g), weighted=False)))
query("sssp_unreached", sssp_sql(PLACED, "adj.weight", 6, CUSTOMER_ROOT))(lambda s, d: _distances(kernels.sssp(placed(s, d), _customer_root(s, d))))
query("wcc", wcc_sql(CO, "id, component"))(lambda s, d: kernels.wcc(copurchase(s, d)))
query("wcc_many", wcc_sql(PLACED, "id, component"))(lambda s, d: kernels.wcc(placed(s, d)))
query("component_sizes", wcc_sql(PLACED, 'row_number() over (order by component) - 1 "number", component, count(*) size', "group by component"))(
    lambda s, d: kernels.component_numbers(kernels.wcc(placed(s, d)))
)
query("cdlp", cdlp_sql(CO))(lambda s, d: kernels.cdlp(copurchase(s, d)))
query("lcc", f"{CO}{TRI} select deg.id, round(case when degree > 1 then 2.0::double * coalesce(triangles, 0) / (degree * (degree - 1)) else 0 end, 9) lcc from deg left join t on t.id = deg.id")(
    lambda s, d: kernels.lcc(copurchase(s, d)).select("id", F.round("lcc", 9).alias("lcc"))
)
query("triangle_count", f"{CO}{TRI} select count(*) triangles from tri")(lambda s, d: kernels.triangle_count(copurchase(s, d)))
query("triangles_per_vertex", f"{CO}{TRI} select id, triangles from t")(lambda s, d: kernels.triangles(copurchase(s, d)))

# Log, snapshots and mutations

query("snapshot_latest", f"{SNAP} select lo, hi, weight, seq from und")(lambda s, d: mlog.snapshot(log(s, d)))
query("snapshot_asof", f"{EARLY} select lo, hi, weight, seq from und")(lambda s, d: mlog.snapshot(log(s, d), 5000))
query("upsert_last_wins", f"with {LOG} select lo, hi, arg_max(weight, seq) weight, count(*) writes from plog where op = 'U' group by 1, 2")(
    lambda s, d: mlog.paired(log(s, d)).where("op = 'U'").groupBy("lo", "hi").agg(F.max_by("weight", "seq").alias("weight"), F.count("*").alias("writes"))
)
query("edge_validity_intervals", f"with {LOG} select lo, hi, weight, seq created, nxt deleted from (select *, lead(seq) over (partition by lo, hi order by seq) nxt from plog) where op = 'U'")(lambda s, d: mlog.validity(log(s, d)))
query("delete_semantics", f"with {LOG} select op, existed, count(*) n from (select op, coalesce(lag(op) over (partition by lo, hi order by seq) = 'U', false) existed from plog) group by 1, 2")(
    lambda s, d: mlog.effects(log(s, d)).groupBy("op", "existed").agg(F.count("*").alias("n"))
)


def _new_edges(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select((F.col("o_custkey") % 100).alias("src"), (F.col("o_orderkey") % 130).alias("dst")).where("src <> dst").distinct().withColumn("weight", F.lit(1.0))


NEW = "neu as (select distinct o_custkey % 100 src, o_orderkey % 130 dst, 1.0::double weight from orders where o_custkey % 100 <> o_orderkey % 130)"
query("insert_if_absent", f"{SNAP}, {NEW} select src, dst, weight from neu where src in (select id from v) and dst in (select id from v) and not exists (select 1 from und where lo = least(src, dst) and hi = greatest(src, dst))")(
    lambda s, d: mlog.insert_if_absent(log(s, d), _new_edges(s, d))
)
query("modify_existing", f"{SNAP}, {NEW} select src, dst, weight from neu where exists (select 1 from und where lo = least(src, dst) and hi = greatest(src, dst))")(
    lambda s, d: mlog.modify_existing(log(s, d), _new_edges(s, d))
)
query("remove_vertex_cascade", f"{SNAP} select src id, count(*) removed from adj where src % 7 = 0 group by 1")(
    lambda s, d: mlog.remove_vertices(g := _snap(s, d), g.vertices.where("id % 7 = 0"))[1]
)
query("remove_vertex_rest", f"{SNAP} select lo, hi, weight from und where lo % 7 <> 0 and hi % 7 <> 0")(
    lambda s, d: mlog.remove_vertices(g := _snap(s, d), g.vertices.where("id % 7 = 0"))[0].edges
)
query("remove_isolated_vertex", f"{PLACED} select id, degree = 0 removed from deg")(lambda s, d: mlog.remove_isolated(g := placed(s, d), g.vertices))
query("remove_tail_vertex", f"{PLACED} select id, degree = 0 and id = (select max(id) from v) removed from deg")(lambda s, d: mlog.remove_tail(g := placed(s, d), g.vertices))
query("compact_preserves_snapshot", f"with {snap_sql('7000')} select lo, hi, weight from und")(lambda s, d: mlog.snapshot(mlog.compact(log(s, d), 5000), 7000).select("lo", "hi", "weight"))
query("conflict_detection", f"with {LOG}, e as (select seq, src id from log union all select seq, dst from log) select distinct id from e where seq % 100 = 0 and id in (select id from e where seq > 9000)")(
    lambda s, d: mlog.conflicts(log(s, d), log(s, d).where("seq % 100 = 0"), 9000)
)
query("multiedge_force_insert", f"with {LOG}, l as (select *, (seq % 4)::int label, max(case when op = 'D' then seq end) over (partition by src, seq % 4, dst) gone from log) select src, label, dst, weight payload, seq from l where op = 'U' and (gone is null or seq > gone)")(
    lambda s, d: mlog.put_edges(_labelled(s, d), force_insert=True)
)
query("labelled_edges", "select user_id src, event_type label, cast(json_extract_string(props, '$.k') as bigint) dst, arg_max(value, event_id) weight from events group by 1, 2, 3")(
    lambda s, d: table(s, d, "events").groupBy(F.col("user_id").alias("src"), F.col("event_type").alias("label"), F.get_json_object("props", "$.k").cast("long").alias("dst")).agg(F.max_by("value", "event_id").alias("weight"))
)
query("vertex_payload_latest", "select user_id id, arg_max(event_type, event_id) payload from events where event_id <= 8000 group by 1 having arg_max(event_type, event_id) <> 'error'")(
    lambda s, d: mlog.latest_payload(table(s, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", None).otherwise(F.struct("event_type")).alias("payload")), 8000).select("id", "payload.event_type").withColumnRenamed("event_type", "payload")
)



def _labelled(s: SparkSession, d: str) -> DataFrame:
    label = F.pmod("event_id", F.lit(4)).cast("int").alias("label")
    op = F.when(F.col("event_type") == "error", "D").otherwise("U").alias("op")
    return table(s, d, "events").select(F.col("event_id").alias("seq"), op, F.col("user_id").alias("src"), label, F.get_json_object("props", "$.k").cast("long").alias("dst"), F.col("value").alias("payload"))


query("labelled_snapshot", f"with {LOG}, l as (select *, (seq % 4)::int label from log where seq <= 8000) select src, label, dst, arg_max(weight, seq) payload from l group by 1, 2, 3 having arg_max(op, seq) = 'U'")(lambda s, d: mlog.labelled_snapshot(_labelled(s, d), 8000))
query("property_snapshot", "select user_id id, event_type property, arg_max(value, event_id) \"value\" from events where event_id <= 8000 group by 1, 2")(
    lambda s, d: mlog.properties(table(s, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"), F.col("event_type").alias("property"), "value"), 8000)
)
query("visible_epoch", f"with {LOG} select seq, op, src, dst from log where (seq // 1000, seq % 1000) < (5, 250)")(
    lambda s, d: mlog.visible(log(s, d).selectExpr("seq", "op", "src", "dst", "seq div 1000 epoch", "seq % 1000 intra"), 5, 250).select("seq", "op", "src", "dst")
)
query("published_epoch", f"with {LOG}, e as (select distinct seq // 3 epoch from log where op = 'U'), r as (select epoch, row_number() over (order by epoch) - 1 k from e) select coalesce(max(epoch) filter (epoch = k), -1) epoch from r")(
    lambda s, d: mlog.published_epoch(log(s, d).where("op = 'U'").selectExpr("seq div 3 epoch"))
)
query("merge_updates", f"with {snap_sql('5000')}, n as (select lo, hi, arg_max(op, seq) op, arg_max(weight, seq) weight from plog where seq > 5000 group by 1, 2) select coalesce(und.lo, n.lo) lo, coalesce(und.hi, n.hi) hi, case when op = 'U' then n.weight else und.weight end weight from und full join n on n.lo = und.lo and n.hi = und.hi where op is null or op = 'U'")(
    lambda s, d: mlog.merge_updates(mlog.snapshot(log(s, d), 5000), mlog.paired(log(s, d)).where("seq > 5000").groupBy("lo", "hi").agg(F.max_by("op", "seq").alias("op"), F.max_by("weight", "seq").alias("weight")))
)
query("insert_vertex", f"{PLACED} select distinct l_partkey id, l_partkey not in (select id from v) inserted from lineitem")(lambda s, d: mlog.insert_vertices(placed(s, d), table(s, d, "lineitem").select(F.col("l_partkey").alias("id"))))
query("new_vertices", f"{CO} select max(id) + 1 + k id from v, (select unnest(range(5)) k) group by k")(lambda s, d: mlog.new_vertices(copurchase(s, d), 5))

# Workloads


def _edges(s: SparkSession, d: str) -> DataFrame:
    return copurchase(s, d).edges.select(F.col("lo").alias("src"), F.col("hi").alias("dst"), "weight")


def placed_sql(seed: int, *keys: str, of: str = "und") -> str:
    """Rows with their place in seeded order."""
    return f"select *, row_number() over (order by {hash_sql(seed, *keys)}, {', '.join(keys)}) - 1 place from {of}"


for _kind, (_r, _m) in workload.MIXES.items():
    _re, _mo = (f"(select count(*) from und) // {x}" if x else "0" for x in (_r, _m))
    query(
        f"mixed_round_{_kind}",
        f"{CO}, r as ({placed_sql(42001, 'lo', 'hi')}), k as (select {_re} re, {_mo} mo) select lo src, hi dst, case when place < re then weight else {hash_sql(42, '1', 'lo', 'hi')} % 9900 / 100 + 1 end weight, case when place < re then 'REINSERT' else 'MODIFY' end \"action\" from r, k where place < re + mo",
    )(lambda s, d, k=_kind: workload.mixed_round(_edges(s, d), k, 42, 1))
    _sql = ", ".join(f"(select count(*) from und) // {x} {n}" if x else f"0 {n}" for x, n in ((_r, "reinserts"), (_m, "modifies")))
    query(f"mixed_round_counts_{_kind}", f"{CO}, c as (select {_sql}) select reinserts, modifies, 2 * reinserts + modifies transactions from c")(
        lambda s, d, k=_kind: workload.round_stats(workload.mixed_round(_edges(s, d), k, 42, 1))
    )
query("hotset_plan_counts", "with p as (select unnest([0, 20, 40, 60, 80, 100]) percent), r as (select percent, 1001 h, case percent when 0 then 1001 // 2 when 100 then 0 else (1001 * (100 - percent) + 100) // 200 end reinserts from p) select percent, reinserts, h - 2 * reinserts updates from r")(
    lambda s, d: s.createDataFrame([(p, *workload.hot_plan(1001, p)) for p in (0, 20, 40, 60, 80, 100)], "percent int, reinserts int, updates int")
)
query("hotset_rounds", "select f fraction, ceil(5 / f)::int rounds from (select unnest([0.01, 0.1, 0.5, 1.0])::double f)")(
    lambda s, d: s.createDataFrame([(f, workload.hot_rounds(f)) for f in (0.01, 0.1, 0.5, 1.0)], "fraction double, rounds int")
)


def _churned(s: SparkSession, d: str) -> DataFrame:
    return workload.churn(copurchase(s, d), 11)


query("churn_invariants", f"{CO} select count(*) edges, count(*) replaced, count(*) distinct_pairs, 0::bigint present from und")(
    lambda s, d: _churned(s, d).join(copurchase(s, d).edges.select("lo", "hi", F.lit(1).alias("old")), (F.least("src", "new_dst") == F.col("lo")) & (F.greatest("src", "new_dst") == F.col("hi")), "left")
    .agg(F.count("*").alias("edges"), F.count("new_dst").alias("replaced"), F.count_distinct(F.least("src", "new_dst"), F.greatest("src", "new_dst")).alias("distinct_pairs"), F.count("old").alias("present"))
)
query("split_update", f"with {LOG} select seq * 2 + k seq, case k when 0 then 'D' else 'U' end op, src, dst, weight from log, (select unnest([0, 1]) k)")(lambda s, d: workload.split_updates(log(s, d)))
query("repeat_writes", f"with {LOG} select turn, case turn when 1 then dst else src end src, case turn when 1 then src else dst end dst, weight from log, (select unnest([0, 1, 2]) turn)")(lambda s, d: workload.repeat_writes(log(s, d), 3))
query("insert_stream_general_split", f"{CO}, n as (select count(*) e from und) select 'load' part, floor(0.8 * e)::bigint n from n union all select 'insert', e - floor(0.8 * e)::bigint from n")(
    lambda s, d: workload.general_split(copurchase(s, d).edges.select(F.col("lo").alias("src"), F.col("hi").alias("dst"), "weight"), 5).groupBy("part").agg(F.count("*").alias("n"))
)
query("high_degree_stream", f"{CO}, p as (select id, degree from deg order by degree desc, id limit (select greatest(1, ceil(0.2 * count(*)))::bigint from v)) select lo, hi, weight from und where lo in (select id from p where degree > 20) and hi in (select id from p where degree > 20)")(
    lambda s, d: workload.by_degree(copurchase(s, d), True, 0.2, 20)
)
query("low_degree_stream", f"{CO} select lo, hi, weight from und where lo in (select id from deg where degree < 30) and hi in (select id from deg where degree < 30)")(lambda s, d: workload.by_degree(copurchase(s, d), False, 0, 30))
query("busiest_end_order", f"{CO} select lo, hi, greatest(a.degree, b.degree) busiest from und join deg a on a.id = lo join deg b on b.id = hi order by 3 desc, 1, 2 limit (select count(*) // 10 from und)")(lambda s, d: workload.by_busiest_end(copurchase(s, d)))
query("high_degree_vertex_queries", f"{CO}, p as (select id, degree from deg order by degree desc, id limit (select greatest(1, ceil(0.01 * count(*)))::bigint from v)) select id, degree from p where degree > 20")(lambda s, d: workload.high_vertices(copurchase(s, d), 0.01, 20))
query("vertex_query_counts", f"{CO} select count(*) * 20 // 100 n, count(*) * 20 // 100 distinct_ids, 0::bigint strangers from v")(
    lambda s, d: reads.has_vertex(copurchase(s, d), workload.vertex_queries(copurchase(s, d), 0.2, 3)).agg(F.count("*").alias("n"), F.count_distinct("id").alias("distinct_ids"), F.count(F.when(~F.col("found"), 1)).alias("strangers"))
)
query("edge_query_counts", f"{CO} select count(*) * 20 // 100 n, count(*) * 20 // 100 found from und")(
    lambda s, d: reads.get_edges(copurchase(s, d), workload.edge_queries(copurchase(s, d).edges.select(F.col("lo").alias("src"), F.col("hi").alias("dst")), 0.2, 3)).agg(F.count("*").alias("n"), F.count(F.when(F.col("found"), 1)).alias("found"))
)
query("mixed_stream_counts", f"{CO}, n as (select count(*) e, count(*) - floor(0.8 * count(*))::bigint rest from und), b as (select unnest(range(32)) batch) select batch, greatest(0, least(rest, (batch + 1) * ((rest + 31) // 32)) - batch * ((rest + 31) // 32)) inserts, 1::bigint queries from b, n")(
    lambda s, d: workload.mixed_stream(copurchase(s, d), 5).groupBy("batch").agg(F.count(F.when(F.col("op") == "U", 1)).alias("inserts"), F.count(F.when(F.col("op") == "Q", 1)).alias("queries"))
)
query("general_split_rows", f"{CO}, r as ({placed_sql(5, 'lo', 'hi')}) select lo src, hi dst, weight, case when place < floor(0.8 * (select count(*) from und)) then 'load' else 'insert' end part from r")(lambda s, d: workload.general_split(_edges(s, d), 5))
query("vertex_queries", f"{CO}, r as ({placed_sql(3, 'id', of='v')}) select place seq, id from r where place < (select count(*) * 20 // 100 from v)")(lambda s, d: workload.vertex_queries(copurchase(s, d), 0.2, 3))
query("edge_queries", f"{CO}, r as ({placed_sql(3, 'lo', 'hi')}) select place seq, lo src, hi dst from r where place < (select count(*) * 20 // 100 from und)")(lambda s, d: workload.edge_queries(_edges(s, d).drop("weight"), 0.2, 3))
query("mixed_stream", f"{CO}, n as (select floor(0.8 * count(*))::bigint first, greatest(1, (count(*) - floor(0.8 * count(*))::bigint + 31) // 32) size from und), r as ({placed_sql(5, 'lo', 'hi')}), q as ({placed_sql(5, 'id', of='v')}) select (place - first) // size batch, 'U' op, lo src, hi dst from r, n where place >= first union all select place, 'Q', id, null from q where place < 32")(
    lambda s, d: workload.mixed_stream(copurchase(s, d), 5)
)
query("update_stream", "select case when event_id - (select min(event_id) from events) < floor(0.8 * (select count(*) from events)) then 'load' else 'insert' end part, count(*) n from events group by 1")(
    lambda s, d: workload.ordered_split(table(s, d, "events").crossJoin(table(s, d, "events").agg(F.min("event_id").alias("first"))).select((F.col("event_id") - F.col("first")).alias("at")), "at").groupBy("part").agg(F.count("*").alias("n"))
)
DRAWS = "w as (select id src, count(*) draws from (select {draw} % (select count(*) from pool) place from (select unnest(range(1000)) id)) join r using (place) group by 1), e as (select lo src, hi dst, weight, row_number() over (partition by lo order by {own}, hi) - 1 place from und) select src, dst, weight, case when place < coalesce(draws, 0) then 'insert' else 'load' end part from e left join w using (src)".format(draw=hash_sql(6, "id"), own=hash_sql(5, "lo", "hi"))
query("insert_stream_uniform", f"{CO}, pool as (select id from v), r as ({placed_sql(5, 'id', of='pool')}), {DRAWS}")(lambda s, d: workload.drawn_stream(copurchase(s, d), 1000, 5, False))
query("insert_stream_based_on_degree", f"{CO}, pool as (select src id, dst from adj), r as ({placed_sql(5, 'id', 'dst', of='pool')}), {DRAWS}")(lambda s, d: workload.drawn_stream(copurchase(s, d), 1000, 5, True))
query("insert_stream_full", f"{CO} select 'U' op, lo src, hi dst, weight from und")(lambda s, d: copurchase(s, d).edges.select(F.lit("U").alias("op"), F.col("lo").alias("src"), F.col("hi").alias("dst"), "weight"))


@query("churn_rounds_invariants", f"{CO}, e as (select count(*) edges, count(*) distinct_pairs from und) select round, edges, distinct_pairs from e, (select unnest([1, 2]) round)")
def churn_rounds_invariants(s: SparkSession, d: str) -> DataFrame:
    rounds = workload.churn_rounds(copurchase(s, d), 2, 11)
    counts = [g.edges.agg(F.count("*").alias("edges"), F.count_distinct("lo", "hi").alias("distinct_pairs")).withColumn("round", F.lit(i)) for i, (_, g) in enumerate(rounds, 1)]
    return counts[0].union(counts[1])


query("degree_cdf", f"{CO}, h as (select degree, count(*) n from deg group by 1) select degree, sum(n) over (order by degree)::bigint at_most from h")(
    lambda s, d: copurchase(s, d).degrees().groupBy("degree").agg(F.count("*").alias("n")).selectExpr("degree", "sum(n) over (order by degree) at_most")
)
query("dedup_last", f"with {LOG} select src, dst, arg_max(weight, seq) weight from log group by 1, 2")(lambda s, d: log(s, d).groupBy("src", "dst").agg(F.max_by("weight", "seq").alias("weight")))
query("dense_remap", f"with {LOG}, f as (select id, min(k) k from (select src id, 2 * seq k from log union all select dst, 2 * seq + 1 from log) group by 1) select id, row_number() over (order by k) - 1 dense from f")(lambda s, d: dense_remap(log(s, d)))
query("ntile_batches", "select batch, count(*) n from (select event_id * 32 // (select count(*) from events) + 1 batch from events) group by 1")(
    lambda s, d: workload.batches(table(s, d, "events"), "event_id").groupBy("batch").agg(F.count("*").alias("n"))
)
query("edge_keys", f"{CO} select lo, hi, (lo << 32) | hi \"key\" from und")(lambda s, d: copurchase(s, d).edges.select("lo", "hi", edge_key("lo", "hi").alias("key")))
query("graphlog_replay", f"with {LOG}, r as (select *, case when op = 'D' then -1.0 else weight end w from plog) select lo, hi, arg_max(w, seq) weight from r group by 1, 2 having arg_max(w, seq) >= 0")(
    lambda s, d: mlog.snapshot(log(s, d).withColumn("w", F.when(F.col("op") == "D", -1.0).otherwise(F.col("weight"))).select("seq", F.when(F.col("w") < 0, "D").otherwise("U").alias("op"), "src", "dst", F.col("w").alias("weight"))).select("lo", "hi", "weight")
)
query("read_window", f"with {LOG}, m as (select max(seq) m from log) select seq, op, src, dst from log, m where seq > 0.1 * m and seq < 0.9 * m")(
    lambda s, d: log(s, d).crossJoin(log(s, d).agg(F.max("seq").alias("m"))).where("seq > 0.1D * m and seq < 0.9D * m").select("seq", "op", "src", "dst")
)

# Metrics and streams

query("latency_summary", "select event_type algorithm, count(*) executions, (sum(floor(value * 1000)::bigint) // count(*)) / 1000 mean_ms from events group by 1")(
    lambda s, d: metrics.latency(table(s, d, "events").select(F.col("event_type").alias("algorithm"), F.floor(F.col("value") * 1000).alias("micros")))
)
SERIES = "smp as (select user_id series, event_id time, value, case when event_type in ('error', 'signup') then event_type end marker from events)"


def _samples(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select(F.col("user_id").alias("series"), F.col("event_id").alias("time"), "value", F.when(F.col("event_type").isin("error", "signup"), F.col("event_type")).alias("marker"))


query("phase_summary", f"with {SERIES}, m as (select *, last_value(marker ignore nulls) over (partition by series order by time rows between unbounded preceding and current row) last_marker, first_value(value) over (partition by series order by time) baseline from smp) select series, last_marker, min(time) \"begin\", max(time) - min(time) held, round(max(value - baseline), 6) peak from m where last_marker is not null group by 1, 2")(
    lambda s, d: metrics.phases(_samples(s, d)).withColumn("peak", F.round("peak", 6))
)
query("interp_grid", f"with {SERIES}, e as (select series, min(time) t0, max(time) t1 from smp group by 1 having min(time) < max(time)), p as (select series, (time - t0)::double / (t1 - t0) p, value, lead((time - t0)::double / (t1 - t0)) over (partition by series order by time) q, lead(value) over (partition by series order by time) nxt from smp join e using (series)), g as (select unnest(range(0, 21)) step) select series, step, round(value + (nxt - value) * (step / 20.0::double - p) / (q - p), 6) \"value\" from p join g on step / 20.0::double >= p and (step / 20.0::double < q or (q = 1 and step = 20)) where q is not null")(
    lambda s, d: metrics.on_grid(_samples(s, d), 20).withColumn("value", F.round("value", 6))
)
MARKS = ("base", "begin", "middle", "middle", "end")


def _memory(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Values as memory samples and four markers, of which the last comes twice, for each of ten series."""
    e = table(s, d, "events").select((F.col("user_id") % 10).alias("series"), F.col("event_id").cast("double").alias("time"), "value")
    marks = s.createDataFrame([("base", 100.5), ("begin", 200.5), ("middle", 400.5), ("end", 900.5), ("end", 950.0)], "marker string, time double")
    return e, s.range(10).withColumnRenamed("id", "series").crossJoin(marks)


MEM = "mem as (select user_id % 10 series, event_id::double time, value from events), base as (select series, arg_min(value, time) baseline from mem where time >= 100.5 group by 1), ph as (select mem.series, time, value - baseline grown, value, baseline, phase, t0, t1 from mem join base using (series), (values (1, 200.5::double, 400.5::double), (2, 400.5::double, 900.5::double)) x(phase, t0, t1) where time between t0 and t1)"
query("phase_report", f"with {MEM} select series, min(baseline) baseline, arg_max(value, time) filter (phase = 1) first_end, max(value) filter (phase = 2) second_peak, 200.0::double first_held, 500.0::double second_held, round(arg_max(grown, time) filter (phase = 1), 6) first_growth, round(max(grown) filter (phase = 2), 6) second_growth, 700.0::double held from ph group by 1")(
    lambda s, d: metrics.phase_report(*_memory(s, d), MARKS).withColumns({"first_growth": F.round("first_growth", 6), "second_growth": F.round("second_growth", 6)})
)
query("phase_curve", f"with {MEM}, k as (select 1 phase, unnest(range(80)) step, 79.0::double n, 0.0::double b, 0.1::double w union all select 2, unnest(range(320)), 319.0, 0.1, 0.9), q as (select series, phase, (time - t0) / (t1 - t0) p, grown from ph), s as (select series, k.phase, step, b + w * step / n x, step / n at_p from k, (select distinct series from q)), z as (select s.*, (select max(p) from q where q.series = s.series and q.phase = s.phase and p <= at_p) p0, (select min(p) from q where q.series = s.series and q.phase = s.phase and p > at_p) p1 from s) select z.series, z.phase, z.step, round(x, 9) x, round(case when p0 is null then b.grown when p1 is null then a.grown else a.grown + (b.grown - a.grown) * (at_p - p0) / (p1 - p0) end, 6) \"value\" from z left join q a on a.series = z.series and a.phase = z.phase and a.p = p0 left join q b on b.series = z.series and b.phase = z.phase and b.p = p1")(
    lambda s, d: metrics.phase_curve(*_memory(s, d), MARKS).withColumns({"x": F.round("x", 9), "value": F.round("value", 6)})
)
query("memory_peaks", "select user_id series, count(*) samples, max(event_id) - min(event_id) duration, max(floor(value * 100)::bigint) / 1024 peak_rss_mb, max(floor(value * 200)::bigint) / 1024 peak_hwm_mb from events group by 1")(
    lambda s, d: metrics.memory_peaks(table(s, d, "events").select(F.col("user_id").alias("series"), F.col("event_id").alias("time"), F.floor(F.col("value") * 100).alias("rss_kb"), F.floor(F.col("value") * 200).alias("hwm_kb")))
)
query("marked_lines", "select event_id, case when regexp_matches(event_type, 'err') then 'failed' when regexp_matches(event_type, '^[a-p]') then 'early' end marker from events where regexp_matches(event_type, 'err|^[a-p]')")(
    lambda s, d: metrics.mark_lines(table(s, d, "events").select("event_id", F.col("event_type").alias("line")), {"failed": "err", "early": "^[a-p]"}).select("event_id", "marker")
)
query("stream_window_counts", "select date_trunc('hour', ts) \"start\", event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2")(
    lambda s, d: window_counts(table(s, d, "events")).withColumn("total", F.round("total", 4))
)
query("duration_format", "with x as (select event_id, floor(\"value\" * 400) / 10 v from events), m as (select *, floor(v / 60)::bigint m, v - floor(v / 60)::bigint * 60 rest from x) select event_id, case when v < 60 then printf('%.1fs', v) when m < 60 and rest < 0.5 then printf('%dm', m) when m < 60 then printf('%dm %ds', m, round_even(rest, 0)::bigint) else printf('%dh %dm', m // 60, m % 60) end shown from m")(
    lambda s, d: table(s, d, "events").select("event_id", (F.floor(F.col("value") * 400) / 10).alias("v")).select("event_id", duration("v").alias("shown"))
)
HOT = f"{mix_sql('k', 'und', f'xor(lo::uhugeint * 4294967296 + hi::uhugeint, {int(mix(np.array([42], np.uint64))[0])}::uhugeint)')}, hot as (select lo src, hi dst, weight, (mixed // 2)::bigint \"rank\" from k order by \"rank\", src, dst, weight limit (select greatest(1, floor(0.05 * count(*)))::bigint from und))"
query("hotset_select", f"{CO}, {HOT} select src, dst, weight, \"rank\" from hot")(lambda s, d: workload.hot_edges(_edges(s, d), 0.05, 42))
query("hotset_gen", f"{CO}, h as (select id from deg where degree > 0 order by -ln((({hash_sql(42, 'id')} >> 8) + 1) / (4503599627370497)::double) / degree, id limit (select greatest(1, ceil(0.01 * count(*)))::bigint from v)) select lo, hi, weight from und where lo in (select id from h) or hi in (select id from h)")(
    lambda s, d: workload.edges_at(copurchase(s, d), workload.weighted_vertices(copurchase(s, d), 0.01, 42))
)
query("hotset_updates", f"{CO}, {HOT}, n as (select count(*) size from hot), r as ({placed_sql(7, 'src', 'dst', of='hot')}), {mix_sql('u', '(select unnest(range(1000)) id)', 'id + 7')}, x as (select id, case when mixed >= 9223372036854775808 then mixed::varchar::hugeint - 18446744073709551616::hugeint else mixed::varchar::hugeint end h from u) select id seq, src, dst, 1 + ((h % 9900 + 9900) % 9900)::bigint / 100 weight from x, n join r on place = ((h % size + size) % size)::bigint")(
    lambda s, d: workload.hot_updates(workload.hot_edges(_edges(s, d), 0.05, 42), 1000, 7)
)
query("mixhash", f"with {mix_sql('a', 'events', 'event_id')}, {mix_sql('b', '(select event_id id, user_id u, mixed of_id from a)', f'xor(least(u, id)::uhugeint * 4294967296 + greatest(u, id)::uhugeint, {int(mix(np.array([42], np.uint64))[0])}::uhugeint)')} select id event_id, case when of_id >= 9223372036854775808 then (of_id::varchar::hugeint - 18446744073709551616::hugeint)::bigint else of_id::bigint end mixed, (mixed // 2)::bigint \"rank\" from b")(
    lambda s, d: table(s, d, "events").select("event_id", mix64("event_id").alias("mixed"), edge_rank("user_id", "event_id", F.lit(42)).alias("rank"))
)

_SIGNED = "case when {x} >= 9223372036854775808 then ({x}::varchar::hugeint - 18446744073709551616::hugeint)::bigint else {x}::bigint end"
query(
    "replay_digests",
    f"{CO}, {mix_sql('c', 'und', 'lo::uhugeint * 4294967296 + hi::uhugeint')}, r as (select mixed as_value, place from ({placed_sql(9, 'lo', 'hi', of='c')})), {mix_sql('p', 'r', 'place')}, "
    f"o as (select as_value, mixed at_place from p), {mix_sql('w', 'o', 'xor(as_value, at_place)')}, t as (select count(*) n, bit_xor(as_value::ubigint) x, bit_xor(mixed::ubigint) y from w) select n, {_SIGNED.format(x='x')} operations, {_SIGNED.format(x='y')} ordered from t",
)(lambda s, d: workload.churn_digests(_edges(s, d).withColumn("new_dst", F.col("dst")), 9))

# Files: written from the tables to the shared folder and read again


def _lines(s: SparkSession, d: str, *fields, sep: str = " ") -> DataFrame:
    return log(s, d).select("seq", F.concat_ws(sep, *(F.col(x).cast("string") if isinstance(x, str) else x for x in fields)).alias("value"))


query("edge_list_scan", f"with {LOG} select src, dst, weight from log")(lambda s, d: files.edge_list(s, written(_lines(s, d, "src", "dst", "weight").drop("seq"))))
query("edge_list_limit", f"with {LOG} select src, dst, weight, row_number() over (order by seq) - 1 seq from log order by seq limit 500")(
    lambda s, d: files.edge_list(s, written(_lines(s, d, "src", "dst", "weight").orderBy("seq").select("value"), parts=1), limit=500)
)
query("edge_list_lenient", f"with {LOG} select src, dst, 0.0::double weight from log where op = 'U'")(
    lambda s, d: files.edge_list(s, written(_lines(s, d, "src", F.when(F.col("op") == "U", F.col("dst").cast("string")).otherwise("none")).drop("seq")), strict=False)
)
query("preset_scan", f"with {LOG} select src, dst, weight from log")(lambda s, d: _preset(s, d))
query("delimited_scan", f"with {LOG}, n as (select src, dst, weight, op, row_number() over (order by seq) - 1 seq from log) select seq, least(src, dst) src, greatest(src, dst) dst, case when op = 'U' then weight else {hash_sql(7, 'seq')} % 9900 / 100 + 1 end weight from n where src <> dst")(
    lambda s, d: files.delimited_edges(s, written(_lines(s, d, "src", "dst", F.when(F.col("op") == "U", F.col("weight").cast("string")), sep=",").orderBy("seq").select("value"), parts=1))
)
query("graph_log_scan", f"with {LOG} select op, src, dst, case when op = 'D' then -1 else weight end weight from log")(
    lambda s, d: files.decode_graph_log(files.encode_graph_log(log(s, d).repartition(3), 1000)).select("op", "src", "dst", "weight")
)
query("operations_file", f"with {LOG} select seq, op, src, dst, weight from log")(lambda s, d: files.operations(s, _saved(files.write_operations, log(s, d))))
query("hot_set_file", f"{CO} select lo src, hi dst, weight from und")(lambda s, d: files.hot_set(s, _saved(files.write_hot_set, _edges(s, d))))
query("result_file", f"{CO} select printf('%d %.15g', id, degree / 7.0::double) as \"value\" from deg")(
    lambda s, d: s.read.text(_saved(lambda x, p: files.write_result(x, p, "share"), copurchase(s, d).degrees().withColumn("share", F.col("degree") / 7.0)))
)
query("memory_file", "select event_id::double time_sec, floor(\"value\" * 100)::bigint rss_kb, event_type last_marker from events")(
    lambda s, d: files.memory_samples(s, _saved(files.write_csv, _memory_rows(s, d))).select("time_sec", "rss_kb", "last_marker")
)
query("memory_summary", "select 'run' label, max(event_id)::double duration_sec, max(floor(\"value\" * 100)::bigint) peak_rss_kb, count(*) samples, count(*) filter (event_type = 'error') events from events")(
    lambda s, d: s.read.json(_saved(lambda x, p: files.write_memory_summary(x, x.where("last_marker = 'error'").selectExpr("time_sec", "last_marker marker", "'' line"), p), _memory_rows(s, d)))
    .select("label", "duration_sec", "peak_rss_kb", "samples", F.size("events").cast("long").alias("events"))
)


def _saved(write: Callable, rows: DataFrame) -> str:
    path = f"{shared_dir(rows.sparkSession)}/graphloom/file-{uuid.uuid4().hex}"
    write(rows, path)
    return path


def _preset(s: SparkSession, d: str) -> DataFrame:
    files.PRESETS["operations"] = written(_lines(s, d, "src", "dst", "weight").drop("seq"))
    return files.preset(s, "operations")


def _memory_rows(s: SparkSession, d: str) -> DataFrame:
    kb = F.floor(F.col("value") * 100)
    e = table(s, d, "events")
    return e.select(F.col("event_id").cast("double").alias("time_sec"), kb.alias("rss_kb"), (kb / 1024).alias("rss_mb"), kb.alias("hwm_kb"), (kb / 1024).alias("hwm_mb"), kb.alias("vmsize_kb"), (kb / 1024).alias("vmsize_mb"), F.col("event_type").alias("last_marker"))
