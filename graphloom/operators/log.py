"""An append-only log of edge operations, snapshots of it at any version, and transactions against it.

Log columns: ``seq`` (the version), ``op`` (U upsert, D delete), ``src``, ``dst``, ``weight``.
"""

from __future__ import annotations

import threading
import time

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from graphloom.operators.graph import Graph
from graphloom.operators.ranking import ranked
from graphloom.plans.staging import stage_table


def paired(log: DataFrame) -> DataFrame:
    """The log by undirected pair, without self-loops."""
    return log.where("src <> dst").withColumn("lo", F.least("src", "dst")).withColumn("hi", F.greatest("src", "dst"))


def snapshot(log: DataFrame, version: int | None = None) -> DataFrame:
    """Live ``(lo, hi, weight, seq)`` as of a version (the last one if None): the last operation of a pair decides."""
    rows = paired(log)
    if version is not None:
        rows = rows.where(F.col("seq") <= version)
    last = rows.groupBy("lo", "hi").agg(F.max_by(F.struct("op", "weight"), "seq").alias("x"), F.max("seq").alias("seq"))
    return last.where("x.op = 'U'").select("lo", "hi", "x.weight", "seq")


def graph_at(log: DataFrame, version: int | None = None) -> Graph:
    """The graph as of a version; vertices are all ever named by an upsert up to it, with edges or not."""
    rows = log if version is None else log.where(F.col("seq") <= version)
    seen = rows.where("op = 'U' and src <> dst").select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return Graph(seen, snapshot(log, version).select("lo", "hi", "weight"))


def validity(log: DataFrame) -> DataFrame:
    """``(lo, hi, weight, created, deleted)``: each version of an edge and when it holds; deleted is null while it does."""
    order = Window.partitionBy("lo", "hi").orderBy("seq")
    return paired(log).withColumn("deleted", F.lead("seq").over(order)).where("op = 'U'").select("lo", "hi", "weight", F.col("seq").alias("created"), "deleted")


def effects(log: DataFrame) -> DataFrame:
    """Each operation with whether its edge existed just before: deletes of absent edges and true inserts show."""
    order = Window.partitionBy("lo", "hi").orderBy("seq")
    return paired(log).withColumn("existed", F.coalesce(F.lag("op").over(order) == "U", F.lit(False)))


def insert_if_absent(log: DataFrame, new: DataFrame) -> DataFrame:
    """Of ``new(src, dst, weight)`` the rows whose edge is absent while both ends are known."""
    g = graph_at(log)
    rows = new.withColumn("lo", F.least("src", "dst")).withColumn("hi", F.greatest("src", "dst"))
    rows = rows.join(g.edges.select("lo", "hi"), ["lo", "hi"], "left_anti")
    for end in ("lo", "hi"):
        rows = rows.join(g.vertices.withColumnRenamed("id", end), end, "left_semi")
    return rows.select("src", "dst", "weight")


def modify_existing(log: DataFrame, new: DataFrame) -> DataFrame:
    """Of ``new(src, dst, weight)`` the rows whose edge is there."""
    rows = new.withColumn("lo", F.least("src", "dst")).withColumn("hi", F.greatest("src", "dst"))
    return rows.join(snapshot(log).select("lo", "hi"), ["lo", "hi"], "left_semi").select("src", "dst", "weight")


def remove_vertices(g: Graph, ids: DataFrame) -> tuple[Graph, DataFrame]:
    """The graph without ``ids(id)`` and their edges, and ``(id, removed)`` edges that went with each."""
    gone = ids.select("id").distinct()
    hit = g.adjacency().join(gone.withColumnRenamed("id", "src"), "src").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("removed"))
    left = g.edges
    for end in ("lo", "hi"):
        left = left.join(gone.withColumnRenamed("id", end), end, "left_anti")
    return Graph(g.vertices.join(gone, "id", "left_anti"), left.select("lo", "hi", "weight")), hit


def remove_isolated(g: Graph, ids: DataFrame) -> DataFrame:
    """``(id, removed)``: a vertex can be removed alone only if it has no edges."""
    return ids.join(g.degrees(), "id", "left").select("id", F.coalesce(F.col("degree") == 0, F.lit(False)).alias("removed"))


def remove_tail(g: Graph, ids: DataFrame) -> DataFrame:
    """``(id, removed)``: where logical ids must stay dense, a vertex can be removed if it has no edges and is the last."""
    last = g.vertices.agg(F.max("id").alias("last"))
    rows = ids.join(g.degrees(), "id", "left").crossJoin(F.broadcast(last))  # one row
    return rows.select("id", F.coalesce((F.col("degree") == 0) & (F.col("id") == F.col("last")), F.lit(False)).alias("removed"))


def put_edges(log: DataFrame, version: int | None = None, force_insert: bool = False) -> DataFrame:
    """Live ``(src, label, dst, payload, seq)``: the last put of each edge, or with ``force_insert`` every put since the
    edge was last deleted, each an edge of its own."""
    rows = log if version is None else log.where(F.col("seq") <= version)
    if not force_insert:
        last = rows.groupBy("src", "label", "dst").agg(F.max_by(F.struct("op", "payload"), "seq").alias("x"), F.max("seq").alias("seq"))
        return last.where("x.op = 'U'").select("src", "label", "dst", "x.payload", "seq")
    gone = F.max(F.when(F.col("op") == "D", F.col("seq"))).over(Window.partitionBy("src", "label", "dst"))
    return rows.withColumn("gone", gone).where("op = 'U' and (gone is null or seq > gone)").select("src", "label", "dst", "payload", "seq")


def compact(log: DataFrame, oldest: int) -> DataFrame:
    """The log without versions that no reader at ``oldest`` or later can see."""
    rows = paired(log).withColumn("late", F.col("seq") > oldest)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lo", "hi", "late").orderBy(F.desc("seq"))))
    return ranked.where("late or rank = 1 and op = 'U'").select(*log.columns)


def latest_payload(versions: DataFrame, version: int) -> DataFrame:
    """``(id, payload)`` from ``(id, seq, payload)`` as of a version; a null payload is a tombstone."""
    last = versions.where(F.col("seq") <= version).groupBy("id").agg(F.max_by("payload", "seq").alias("payload"))
    return last.where("payload is not null")


def conflicts(log: DataFrame, staged: DataFrame, read_version: int) -> DataFrame:
    """``(id)``: ends of edges that ``staged`` writes and someone else changed after ``read_version``. Edges have no
    direction, so a write touches both ends."""
    end = F.explode(F.array("src", "dst")).alias("id")
    late = log.where(F.col("seq") > read_version).select(end)
    return staged.select(end).distinct().join(late, "id", "left_semi")


def labelled_snapshot(log: DataFrame, version: int | None = None) -> DataFrame:
    """Live ``(src, label, dst, payload)`` of a directed log with labels: each (src, label, dst) is an edge of its own."""
    rows = log if version is None else log.where(F.col("seq") <= version)
    last = rows.groupBy("src", "label", "dst").agg(F.max_by(F.struct("op", "payload"), "seq").alias("x"))
    return last.where("x.op = 'U'").select("src", "label", "dst", "x.payload")


def properties(log: DataFrame, version: int | None = None) -> DataFrame:
    """``(id, property, value)``: the last value set of each property; the log has (seq, id, property, value)."""
    rows = log if version is None else log.where(F.col("seq") <= version)
    return rows.groupBy("id", "property").agg(F.max_by("value", "seq").alias("value"))


def merge_updates(edges: DataFrame, updates: DataFrame) -> DataFrame:
    """``(lo, hi, weight)`` after a batch ``(lo, hi, op, weight)`` with one operation a pair: a full outer merge."""
    new = updates.select("lo", "hi", "op", F.col("weight").alias("new"))
    rows = edges.join(new, ["lo", "hi"], "full_outer").where("op is null or op = 'U'")
    return rows.select("lo", "hi", F.when(F.col("op") == "U", F.col("new")).otherwise(F.col("weight")).alias("weight"))


def insert_vertices(g: Graph, ids: DataFrame) -> DataFrame:
    """``(id, inserted)``: false for ids that are there already; an id asked for twice goes in once."""
    seen = g.vertices.select("id", F.lit(False).alias("inserted"))
    return ids.select("id").distinct().join(seen, "id", "left").select("id", F.coalesce("inserted", F.lit(True)).alias("inserted"))


def new_vertices(g: Graph, n: int) -> DataFrame:
    """``n`` fresh ids after the largest."""
    top = g.vertices.agg(F.max("id")).first()[0]
    start = 0 if top is None else top + 1
    return g.vertices.sparkSession.range(start, start + n)


def visible(log: DataFrame, epoch: int, intra: int) -> DataFrame:
    """Operations before the reader's (epoch, intra), compared as a pair."""
    return log.where(F.struct("epoch", "intra") < F.struct(F.lit(epoch).cast("long").alias("epoch"), F.lit(intra).cast("long").alias("intra")))


def published_epoch(finished: DataFrame) -> DataFrame:
    """``(epoch)``: the last of the finished epochs up to which all from 0 on have finished; -1 if 0 has not."""
    done = finished.select("epoch").distinct()
    ends = done.join(done.select((F.col("epoch") - 1).alias("epoch")), "epoch", "left_anti")
    first = done.agg(F.count(F.when(F.col("epoch") == 0, 1)).alias("begun"))
    return ends.where("epoch >= 0").agg(F.min("epoch").alias("last")).crossJoin(first).select(F.when(F.col("begun") > 0, F.col("last")).otherwise(-1).cast("long").alias("epoch"))


def backoff(attempt: int) -> float:
    """Seconds to wait before trying again: none for sixteen attempts, then doubling from a microsecond to a millisecond."""
    return 0.0 if attempt < 16 else 1e-6 * (1 << min(attempt - 16, 10))


class TransactionConflict(RuntimeError):
    """An object was changed after the transaction's snapshot."""


class TransactionClosed(RuntimeError):
    """The transaction has ended, or only reads."""


class Transaction:
    """Reads one snapshot plus its own writes; commits by appending, unless another writer came first."""

    def __init__(self, store: MutationLog, read_only: bool = False) -> None:
        self.store, self.version, self.read_only, self.open = store, store.version, read_only, True
        self.staged: list[tuple[str, int, int, float | None]] = []

    def _write(self, op: str, src: int, dst: int, weight: float | None) -> None:
        if not self.open or self.read_only:
            raise TransactionClosed("no more writes")
        self.staged.append((op, src, dst, weight))

    def upsert(self, src: int, dst: int, weight: float) -> None:
        self._write("U", src, dst, weight)

    def delete(self, src: int, dst: int) -> None:
        self._write("D", src, dst, None)

    def frame(self) -> DataFrame:
        rows = [(self.version + i + 1, *x) for i, x in enumerate(self.staged)]
        return self.store.spark.createDataFrame(rows, MutationLog.SCHEMA)

    def edges(self) -> DataFrame:
        if not self.open:
            raise TransactionClosed("ended")
        seen = self.store.log.where(F.col("seq") <= self.version)
        return snapshot(seen.unionByName(self.frame()))

    def abort(self) -> None:
        self.open = False

    def commit(self) -> int:
        if not self.open:
            raise TransactionClosed("ended")
        self.open = False
        with self.store.lock:  # nobody appends between the check and the append
            if self.staged:
                if not conflicts(self.store.log, self.frame(), self.version).isEmpty():
                    raise TransactionConflict("changed since the snapshot")
                self.store.append(self.staged)
            return self.store.version


class MutationLog:
    """A log in a Spark session; versions become readable in the order in which they are appended."""

    SCHEMA = "seq long, op string, src long, dst long, weight double"
    #: Commits after which the log is written out as a table.
    STAGE_AFTER = 16

    def __init__(self, spark: SparkSession, log: DataFrame | None = None) -> None:
        self.spark = spark
        self.log = log if log is not None else spark.createDataFrame([], self.SCHEMA)
        self.version = self.log.agg(F.max("seq")).first()[0] or 0
        self.pending = 0
        self.lock = threading.RLock()

    def append(self, ops: list[tuple[str, int, int, float | None]]) -> None:
        with self.lock:
            rows = [(self.version + i + 1, *x) for i, x in enumerate(ops)]
            self.log = self.log.unionByName(self.spark.createDataFrame(rows, self.SCHEMA))
            self.version += len(rows)
            self.pending += 1
            if self.pending == self.STAGE_AFTER:  # the plan would grow with every commit
                self.log, self.pending = stage_table(self.log, "log"), 0

    def extend(self, ops: DataFrame) -> int:
        """Append ``ops(op, src, dst, weight, seq)`` as one batch; ``seq`` numbers them from 0 within it."""
        with self.lock:
            new = ops.select((F.col("seq") + F.lit(self.version + 1)).alias("seq"), "op", "src", "dst", F.col("weight").cast("double").alias("weight"))
            new = stage_table(new, "batch")
            self.log = self.log.unionByName(new)
            self.version += new.count()
            self.pending += 1
            if self.pending == self.STAGE_AFTER:
                self.log, self.pending = stage_table(self.log, "log"), 0
            return self.version

    def bulk_load(self, edges: DataFrame) -> int:
        """Append ``edges(src, dst, weight)`` as upserts in order of ends and weight, all at once and unchecked: for
        loading before any transaction begins."""
        with self.lock:
            rows = ranked(edges.select("src", "dst", "weight", F.monotonically_increasing_id().alias("row")), "src", "dst", "weight", "row", name="seq")
            return self.extend(rows.withColumn("op", F.lit("U")))

    def begin(self, read_only: bool = False) -> Transaction:
        return Transaction(self, read_only)

    def retry(self, work, attempts: int = 8) -> int:
        """Run ``work(transaction)`` and commit, again after conflicts."""
        for i in range(attempts):
            txn = self.begin()
            work(txn)
            try:
                return txn.commit()
            except TransactionConflict:
                if i == attempts - 1:
                    raise
                time.sleep(backoff(i))
        raise AssertionError
