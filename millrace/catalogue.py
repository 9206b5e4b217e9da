"""Registered queries of the pipeline engine, one for each operator, with their DuckDB equivalents. All run over whole tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import tables as in_batch
from millrace.operators import columns as strict
from millrace.operators.batching import BATCH
from millrace.plans.contracts import ColumnSet, schema_of
from millrace.plans.errors import PipelineError
from millrace.plans.executors import LocalExecutor
from millrace.plans.graph import PipelineGraph
from millrace.plans.task import COMMON_ORIGIN, MaxRows, Resources, Task, TaskRegistry
from millrace.plans.tracker import Lineage, OutputBatch, PathStep, PipelineTracker
from millrace.sources.frames import FrameSource, GeneratorSource, NumberedSource, RangeSource
from millrace.streaming.runner import FileStream, StreamRunner

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def events(spark, sf_dir, size: int = 1, *more: str) -> FrameSource:
    return FrameSource(table(spark, sf_dir, "events", "event_id", "user_id", *more), "event_id", size)


def orders(spark, sf_dir, size: int = 1) -> FrameSource:
    return FrameSource(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", size)


def run(spark, graph, source, **more):
    return LocalExecutor(spark, **more).run(graph, source)


def chain(*tasks: Task) -> PipelineGraph:
    g = PipelineGraph()
    g.add_linear(tasks)
    return g


def diamond(merge: Task, *branches: Task, root: Task | None = None) -> PipelineGraph:
    """Branches that meet in merge; without a root all of them read the source."""
    g = PipelineGraph()
    top = g.add_task(root) if root else None
    at = [g.add_task(b) for b in branches]
    end = g.add_task(merge)
    for b in at:
        if top is not None:
            g.add_edge(top, b)
        g.add_edge(b, end)
    return g


def per_batch(run_, task: str) -> DataFrame:
    """bid, n_rows, lo_id, hi_id of each batch with rows, from its rows."""
    data = run_.batched(task)
    key = "event_id" if "event_id" in data.columns else "o_orderkey"
    return data.groupBy(F.col(BATCH).alias("bid")).agg(F.count(F.lit(1)).alias("n_rows"), F.min(key).alias("lo_id"), F.max(key).alias("hi_id"))


_RN = "select *, row_number() over (order by event_id) - 1 as rn from events"
_RO = "select *, row_number() over (order by o_orderkey) - 1 as rn from orders"
_BY = "cast(count(*) as bigint) as n_rows, min({k}) as lo_id, max({k}) as hi_id"
_EV, _OR = _BY.format(k="event_id"), _BY.format(k="o_orderkey")
#: Next-fit groups of batches bs(seq, rows) of at most {n} rows.
_FIT = """r(seq, g, acc) as (select seq, cast(0 as bigint), cast(rows as bigint) from bs where seq = 0 union all
select b.seq, case when r.acc + b.rows <= {n} then r.g else r.g + 1 end, cast(case when r.acc + b.rows <= {n} then r.acc + b.rows else b.rows end as bigint) from r join bs b on b.seq = r.seq + 1)"""


# --- tasks and column operations -------------------------------------------------------------------------------------------------


@query("select l_orderkey, l_linenumber, l_extendedprice, l_extendedprice * 1.5e0 as value, l_extendedprice * 1.5e0 * 2e0 as scaled from lineitem")
def pipe_linear(spark, sf_dir):
    """Two tasks in a row, each adding a column."""
    g = chain(Task.columns("compute_value", "value double", {"value": "l_extendedprice * 1.5D"}, "l_extendedprice double"), Task.columns("scale", "scaled double", {"scaled": "value * 2D"}, "value double"))
    return run(spark, g, FrameSource(table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice"), ["l_orderkey", "l_linenumber"])).frame("scale")


def _times(batch: pa.Table, factor: int) -> pa.Table:
    return in_batch.append_column(batch, "scaled", pc.multiply(in_batch.column_as(batch, "o_totalprice", pa.float64()), float(factor)))


@query("select o_orderkey, o_custkey, o_totalprice, o_totalprice * 10 as scaled from orders")
def task_config_scale(spark, sf_dir):
    """A batch task with a configuration."""
    g = chain(Task.batch_with_config("scale", "o_totalprice double", "scaled double", _times, 10))
    return run(spark, g, orders(spark, sf_dir, 4096)).frame("scale")


@query("select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer")
def passthrough_identity(spark, sf_dir):
    return run(spark, chain(Task.passthrough("same")), FrameSource(table(spark, sf_dir, "customer"), "c_custkey")).frame("same")


@query("select *, p_retailprice * 0.5e0 as half from part")
def col_append(spark, sf_dir):
    return strict.append_column(table(spark, sf_dir, "part"), "half", "p_retailprice * 0.5D")


@query("select p_partkey, p_name, p_brand, p_type, p_retailprice from part")
def col_drop(spark, sf_dir):
    return strict.drop_column(table(spark, sf_dir, "part"), "p_size")


@query("select p_partkey, p_name, p_brand, p_type, cast(p_size as varchar) as p_size, p_retailprice from part")
def col_replace(spark, sf_dir):
    return strict.replace_column(table(spark, sf_dir, "part"), "p_size", "cast(p_size as string)")


@query("select s_suppkey, s_name as supplier_name, s_nationkey, s_acctbal from supplier")
def col_rename(spark, sf_dir):
    return strict.rename_column(table(spark, sf_dir, "supplier"), "s_name", "supplier_name")


@query("select s_suppkey, s_acctbal from supplier")
def col_as(spark, sf_dir):
    df = table(spark, sf_dir, "supplier")
    return df.select(strict.column_as(df, "s_suppkey", "bigint"), strict.column_as(df, "s_acctbal", "double"))


@query("select o_orderkey, o_custkey, cast(floor(o_totalprice) as bigint) as o_totalprice from orders")
def contract_drop_produce(spark, sf_dir):
    """A column dropped and produced anew with another type."""
    t = Task.columns("whole", "o_totalprice bigint", {"o_totalprice": "cast(floor(o_totalprice) as bigint)"}, "o_totalprice double").with_drops("o_totalprice")
    return run(spark, chain(t), orders(spark, sf_dir)).frame("whole")


# --- sources ---------------------------------------------------------------------------------------------------------------------


@query("select cast(range as bigint) as id from range(100)")
def source_default_range(spark, sf_dir):
    return run(spark, chain(Task.passthrough("out")), RangeSource(), max_batches=100).frame("out")


@query("select cast(range as bigint) as x from range(1, 26)")
def source_custom(spark, sf_dir):
    make = lambda: (pa.table({"x": pa.array([i], pa.int64())}) for i in range(1, 26))
    return run(spark, chain(Task.passthrough("out")), GeneratorSource(spark.createDataFrame([], "x bigint").schema, make)).frame("out")


def _made(i: int) -> pa.Table:
    return pa.table({"x": pa.array([i * 10 + k for k in range(i % 4)], pa.int64())})


@query("select i * 10 + k as x, i // 3 as bid from (select cast(unnest(range(1000)) as bigint) as i), (select cast(unnest(range(4)) as bigint) as k) where k < i % 4")
def source_distributed(spark, sf_dir):
    """Batches that workers make from their numbers, every fourth one empty; the graph tells them by their origins."""
    r = run(spark, chain(Task.passthrough("out")), NumberedSource(spark.createDataFrame([], "x bigint").schema, _made), max_batches=1000)
    of = r.batches("out").select(F.col("batch").alias("b"), F.element_at("origins", 1).alias("origin"))
    return r.batched("out").join(of, F.col(BATCH) == F.col("b")).select("x", F.floor(F.col("origin") / 3).alias("bid"))


@query(f"select event_id, user_id from ({_RN}) where rn // 64 < 50")
def source_max_batches(spark, sf_dir):
    """A limit on batches, not on rows."""
    return run(spark, chain(Task.passthrough("out")), events(spark, sf_dir, 64), max_batches=50).frame("out")


@query(f"select rn // 64 as bid, {_EV} from ({_RN}) group by 1")
def source_origins(spark, sf_dir):
    return per_batch(run(spark, chain(Task.passthrough("out")), events(spark, sf_dir, 64)), "out")


@query("select event_id, user_id, 'a' as root from events union all select event_id, user_id, 'b' from events")
def multi_source_roots(spark, sf_dir):
    """Every root gets every batch."""
    g = PipelineGraph()
    for name in "ab":
        g.add_task(Task.columns(name, "root string", {"root": f"'{name}'"}))
    r = run(spark, g, events(spark, sf_dir))
    return r.frame("a").unionByName(r.frame("b"))


# --- topology --------------------------------------------------------------------------------------------------------------------


@query("select o_orderkey, o_custkey, o_totalprice, o_totalprice * 2 as doubled, 'x' as sink from orders union all select o_orderkey, o_custkey, o_totalprice, o_totalprice * 2, 'y' from orders")
def fanout_multi_sink(spark, sf_dir):
    g = PipelineGraph()
    top = g.add_task(Task.columns("double", "doubled double", {"doubled": "o_totalprice * 2"}))
    g.add_fan_out(top, [Task.columns(s, "sink string", {"sink": f"'{s}'"}) for s in "xy"])
    r = run(spark, g, orders(spark, sf_dir))
    return r.frame("x").unionByName(r.frame("y"))


def _tagged(name: str, mode=None) -> Task:
    t = Task.columns(f"branch_{name}", f"from_{name} double", {f"from_{name}": "1.0D"})
    return t.with_mode(mode) if mode else t


@query("select event_id, user_id from events union all select event_id, user_id from events")
def diamond_union(spark, sf_dir):
    """A merge keeps the columns that both branches have."""
    return run(spark, diamond(Task.passthrough("merge"), _tagged("b"), _tagged("c")), events(spark, sf_dir)).frame("merge")


@query("select event_id, user_id from events union all select event_id, user_id from events union all select event_id, user_id from events")
def diamond_triple(spark, sf_dir):
    return run(spark, diamond(Task.passthrough("merge"), *map(_tagged, "bcd"), root=Task.passthrough("top")), events(spark, sf_dir)).frame("merge")


@query("select event_id from events union all select event_id from events")
def merge_type_conflict(spark, sf_dir):
    """A column of two types is no common one."""
    other = Task.columns("text", "user_id string", {"user_id": "cast(user_id as string)"}).with_drops("user_id")
    return run(spark, diamond(Task.passthrough("merge"), Task.passthrough("same"), other), events(spark, sf_dir)).frame("merge")


# --- batch formation -------------------------------------------------------------------------------------------------------------


def _grouped(spark, source, *modes):
    tasks = [Task.passthrough(f"t{i}").with_mode(m) for i, m in enumerate(modes)]
    return per_batch(run(spark, chain(*tasks), source), tasks[-1].name)


@query(f"select (rn // 50) // 3 as bid, {_OR} from ({_RO}) group by 1")
def maxrows_accumulate(spark, sf_dir):
    return _grouped(spark, orders(spark, sf_dir, 50), MaxRows(150))


@query(f"with recursive o as ({_RO}), bs as (select rn // 64 as seq, count(*) as rows from o group by 1), {_FIT.format(n=150)} select g as bid, {_OR} from o join r on r.seq = o.rn // 64 group by 1")
def maxrows_nextfit_slack(spark, sf_dir):
    """Groups may stay under the limit, since batches aren't split to fill them."""
    return _grouped(spark, orders(spark, sf_dir, 64), MaxRows(150))


@query(f"select (rn // 200) * 2 + (rn % 200) // 150 as bid, {_OR} from ({_RO}) group by 1")
def maxrows_split(spark, sf_dir):
    """Larger batches are cut."""
    return _grouped(spark, orders(spark, sf_dir, 200), MaxRows(150))


@query(
    f"""with recursive e as (select event_id, row_number() over (partition by cast(ts as date) order by event_id) - 1 as pos, dense_rank() over (order by cast(ts as date)) - 1 as seq from events),
bs as (select seq, count(*) as rows from e group by 1), {_FIT.format(n=1000)},
placed as (select e.event_id, r.g, coalesce((select sum(b.rows) from bs b join r q on q.seq = b.seq where q.g = r.g and b.seq < e.seq), 0) + e.pos as place from e join r on r.seq = e.seq),
part as (select g, cast(place // 1000 as bigint) as p, event_id from placed),
num as (select g, p, row_number() over (order by g, p) - 1 as bid from (select distinct g, p from part))
select bid, {_EV} from part join num using (g, p) group by 1"""
)
def maxrows_nonuniform(spark, sf_dir):
    """Batches of a day each."""
    source = FrameSource(table(spark, sf_dir, "events", "event_id", "ts"), "event_id", batch_by="cast(ts as date)")
    return _grouped(spark, source, MaxRows(1000))


@query(f"select rn // 7 as bid, {_EV} from ({_RN}) where rn // 7 = (select max(rn) // 7 from ({_RN})) group by 1")
def maxrows_flush_tail(spark, sf_dir):
    """What is left at the end leaves as the last group."""
    all_ = _grouped(spark, events(spark, sf_dir, 1), MaxRows(7))
    return all_.join(F.broadcast(all_.agg(F.max("bid").alias("bid"))), "bid", "left_semi")


@query(f"select rn // 90 as bid, {_EV} from ({_RN}) group by 1")
def maxrows_chain(spark, sf_dir):
    return _grouped(spark, events(spark, sf_dir, 10), MaxRows(30), MaxRows(90))


@query(
    f"""with recursive e as ({_RN}), u as (select event_id, rn // 64 as o, 0 as b from e union all select event_id, rn // 64, 1 from e),
bs as (select row_number() over (order by o, b) - 1 as seq, o, b, count(*) as rows from u group by o, b), {_FIT.format(n=200)}
select g as bid, {_EV} from u join bs using (o, b) join r using (seq) group by 1"""
)
def fanin_maxrows(spark, sf_dir):
    """Two branches queue up in one order, then accumulate."""
    return per_batch(run(spark, diamond(Task.passthrough("merge").with_mode(MaxRows(200)), _tagged("b"), _tagged("c")), events(spark, sf_dir, 64)), "merge")


def _origin(k: str) -> str:
    return f"select rn // 64 {k} as bid, cast(count(*) * {{n}} as bigint) as n_rows, min(event_id) as lo_id, max(event_id) as hi_id from ({_RN}) group by 1"


def _common(spark, sf_dir, *branches: Task):
    return per_batch(run(spark, diamond(Task.passthrough("merge").with_mode(COMMON_ORIGIN), *branches, root=Task.passthrough("top")), events(spark, sf_dir, 64)), "merge")


@query(_origin("").format(n=2))
def common_origin_diamond(spark, sf_dir):
    """All rows of one source batch meet again."""
    return _common(spark, sf_dir, _tagged("b"), _tagged("c"))


@query(_origin("").format(n=3))
def common_origin_triple(spark, sf_dir):
    return _common(spark, sf_dir, *map(_tagged, "bcd"))


@query(_origin("// 2").format(n=2))
def common_origin_asym(spark, sf_dir):
    """One branch groups two source batches."""
    return _common(spark, sf_dir, _tagged("b", MaxRows(128)), _tagged("c"))


@query(
    f"""with e as ({_RN}), n as (select max(rn) // 64 as last from e), iv as (select range * 2 as s, least(range * 2 + 1, last) as e from n, range(0, 1000000) where range * 2 <= last union all
select range * 3, least(range * 3 + 2, last) from n, range(0, 1000000) where range * 3 <= last),
m as (select s, e, max(e) over (order by s, e desc rows between unbounded preceding and 1 preceding) as pe from iv),
c as (select s, e, cast(sum(case when pe is null or s > pe then 1 else 0 end) over (order by s, e desc rows unbounded preceding) - 1 as bigint) as bid from m),
k as (select bid, min(s) as s, max(e) as e from c group by 1)
select bid, cast(count(*) * 2 as bigint) as n_rows, min(event_id) as lo_id, max(event_id) as hi_id from e join k on e.rn // 64 between k.s and k.e group by 1"""
)
def common_origin_lcm(spark, sf_dir):
    """Branches that group by two and by three connect six."""
    return _common(spark, sf_dir, _tagged("b", MaxRows(128)), _tagged("c", MaxRows(192)))


@query(f"select rn // 64 as origin, cast(count(*) * 2 as bigint) as n_rows, cast(sum(user_id) * 2 as bigint) as users from ({_RN}) group by 1")
def common_origin_agg(spark, sf_dir):
    """A frame task over the branches of each origin."""

    def total(df: DataFrame) -> DataFrame:
        return df.groupBy(BATCH).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("user_id").alias("users"), F.min(BATCH).alias("origin"))

    merge = Task.frame("merge", "user_id bigint", "n_rows bigint, users bigint, origin bigint", total, mode=COMMON_ORIGIN).with_drops("event_id", "user_id")
    return run(spark, diamond(merge, _tagged("b"), _tagged("c")), events(spark, sf_dir, 64)).frame("merge").select("origin", "n_rows", "users")


# --- batch functions -------------------------------------------------------------------------------------------------------------


def _position(batch: pa.Table) -> pa.Table:
    return in_batch.append_column(batch, "value", pa.array([i * 1.5 for i in range(batch.num_rows)], pa.float64()))


@query(f"select event_id, user_id, (rn % 100) * 1.5e0 as value from ({_RN})")
def batch_position(spark, sf_dir):
    """A function sees its batch whole and in order."""
    return run(spark, chain(Task.batch("value", None, "value double", _position)), events(spark, sf_dir, 100)).frame("value")


def _even(batch: pa.Table) -> pa.Table:
    return batch.filter(pc.equal(pc.bit_wise_and(batch.column("user_id"), 1), 0))


@query("select event_id, user_id from events where user_id % 2 = 0")
def batch_filter(spark, sf_dir):
    return run(spark, chain(Task.passthrough("even", _even)), events(spark, sf_dir, 500)).frame("even")


def _totals(batch: pa.Table) -> pa.Table:
    return pa.table({"n_rows": pa.array([batch.num_rows], pa.int64()), "users": pa.array([pc.sum(batch.column("user_id")).as_py()], pa.int64())})


@query(f"select cast(count(*) as bigint) as n_rows, cast(sum(user_id) as bigint) as users from ({_RN}) group by rn // 500")
def batch_agg(spark, sf_dir):
    t = Task.batch("totals", "user_id bigint", "n_rows bigint, users bigint", _totals).with_drops("event_id", "user_id")
    return run(spark, chain(t), events(spark, sf_dir, 500)).frame("totals")


def _top(batch: pa.Table) -> pa.Table:
    return batch.sort_by([("user_id", "descending"), ("event_id", "ascending")]).slice(0, 3)


@query(f"select event_id, user_id from (select *, row_number() over (partition by rn // 500 order by user_id desc, event_id) as r from ({_RN})) where r <= 3")
def batch_topk(spark, sf_dir):
    return run(spark, chain(Task.passthrough("top", _top)), events(spark, sf_dir, 500)).frame("top")


def _words(batch: pa.Table) -> pa.Table:
    ids, words = [], []
    for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
        for w in (text or "").split("\n"):
            ids.append(i)
            words.append(len(w))
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "line_chars": pa.array(words, pa.int64())})


@query("select doc_id, cast(length(unnest(string_split(text, chr(10)))) as bigint) as line_chars from documents")
def batch_explode(spark, sf_dir):
    """A batch may give more rows than it had."""
    t = Task.batch("lines", "doc_id bigint, text string", "line_chars bigint", _words).with_drops("text")
    return run(spark, chain(t), FrameSource(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", 200)).frame("lines")


@query(f"select rn // 64 as origin, cast(sum(case when user_id % 2 = 0 then 1 else 0 end) as bigint) as n_rows from ({_RN}) group by 1")
def batch_empty_kept(spark, sf_dir):
    """Batches that lose their rows stay in the control plane."""
    return run(spark, chain(Task.passthrough("even", _even)), events(spark, sf_dir, 64)).batches("even").select(F.element_at("origins", 1).alias("origin"), F.col("rows").alias("n_rows"))


# --- lineage, introspection, storage ---------------------------------------------------------------------------------------------


@query(f"with o as ({_RO}), n as (select max(rn) // 50 as last from o) select 'group' as sink, range // 3 as bid, range as origin from n, range(0, 10000000) where range <= last")
def lineage_origins(spark, sf_dir):
    r = run(spark, chain(Task.passthrough("group").with_mode(MaxRows(150))), orders(spark, sf_dir, 50))
    return r.batches("group").select(F.lit("group").alias("sink"), F.col("batch").alias("bid"), F.explode("origins").alias("origin"))


def _long(spark, sf_dir):
    """top -> (b -> b2, c) -> merge on common origins."""
    g = PipelineGraph()
    top, b, b2, c, m = (g.add_task(Task.passthrough(n)) for n in ("top", "b", "b2", "c", "merge"))
    g.replace_task(m, g.task(m).with_mode(COMMON_ORIGIN))
    for x, y in ((top, b), (b, b2), (top, c), (b2, m), (c, m)):
        g.add_edge(x, y)
    return run(spark, g, events(spark, sf_dir, 64))


@query(f"select distinct rn // 64 as bid, 'top,b,b2,merge' as path from ({_RN})")
def lineage_path(spark, sf_dir):
    """The longest way to each output."""
    return _long(spark, sf_dir).batches("merge").select(F.col("batch").alias("bid"), F.concat_ws(",", "path").alias("path"))


@query(f"with n as (select max(rn) // 64 + 1 as n from ({_RN})) select unnest(['top', 'b', 'b2', 'c', 'merge']) as task, n as runs from n")
def tracker_runs(spark, sf_dir):
    """Runs of every task, also of those off the longest way."""
    return _long(spark, sf_dir).runs()


def _demo() -> PipelineGraph:
    g = PipelineGraph()
    d = g.add_task(Task.columns("double", "doubled double", {"doubled": "id * 2D"}, "id bigint"))
    a, b = g.add_fan_out(d, [Task.passthrough("branch_a"), Task.passthrough("branch_b").with_mode(MaxRows(3))])
    m = g.add_task(Task.passthrough("merge_sink"))
    g.add_edge(a, m)
    g.add_edge(b, m)
    return g


@query("select range as id, range * 2e0 as doubled from range(100) union all select range, range * 2e0 from range(100)")
def demo_pipeline(spark, sf_dir):
    return run(spark, _demo(), RangeSource(), max_batches=100).frame("merge_sink")


@query("select unnest(['double', 'branch_a', 'branch_b', 'merge_sink']) as task, unnest([cast(100 as bigint), 100, 34, 134]) as runs")
def demo_runs(spark, sf_dir):
    return run(spark, _demo(), RangeSource(), max_batches=100).runs()


@query("select * from (values ('double', 2), ('branch_a', 1), ('branch_b', 1), ('merge_sink', 0)) t(task, rank)")
def graph_rank(spark, sf_dir):
    g = _demo()
    return spark.createDataFrame([(g.task(i).name, r) for i, r in g.rank_from_sink().items()], "task string, rank int")


@query(
    """select * from (values ('missing', 'SchemaMismatch', 'nope'), ('bad_type', 'SchemaMismatch', 'event_id (expected int, got bigint)'), ('bad_drop', 'SchemaMismatch', 'nope'),
('dropped', 'SchemaMismatch', 'user_id'), ('after_merge', 'SchemaMismatch', 'from_b'), ('cycle', 'GraphError', ''), ('empty', 'GraphError', '')) t(case_name, error, missing)"""
)
def graph_validate_errors(spark, sf_dir):
    """What validation refuses before anything is read."""
    source = events(spark, sf_dir)
    need = lambda c: Task.columns("need", requires=c)

    def cycle():
        g = chain(Task.passthrough("a"), Task.passthrough("b"))
        g.add_edge(1, 0)

    cases = {
        "missing": lambda: chain(need("nope int")).validate(source.schema(spark)),
        "bad_type": lambda: chain(need("event_id int")).validate(source.schema(spark)),
        "bad_drop": lambda: chain(Task.passthrough("d").with_drops("nope")).validate(source.schema(spark)),
        "dropped": lambda: chain(Task.passthrough("d").with_drops("user_id"), need("user_id bigint")).validate(source.schema(spark)),
        "after_merge": lambda: diamond(need("from_b double"), _tagged("b"), _tagged("c")).validate(source.schema(spark)),
        "cycle": cycle,
        "empty": lambda: PipelineGraph().validate(source.schema(spark)),
    }
    rows = []
    for name, case in cases.items():
        try:
            case()
        except PipelineError as e:
            rows.append((name, type(e).__name__, ",".join(getattr(e, "missing", []))))
    return spark.createDataFrame(rows, "case_name string, error string, missing string")


@query("select doc_id, lang, n_chars from documents union all select doc_id, lang, n_chars from documents")
def storage_roundtrip(spark, sf_dir):
    """Keeping a result doesn't change it."""
    g = PipelineGraph()
    top = g.add_task(Task.passthrough("top", _same))
    g.add_fan_out(top, [Task.passthrough("x"), Task.passthrough("y")])
    source = FrameSource(table(spark, sf_dir, "documents", "doc_id", "lang", "n_chars"), "doc_id", 500)
    r = run(spark, g, source, storage="disk")
    return r.frame("x").unionByName(r.frame("y"))


def _same(batch: pa.Table) -> pa.Table:
    return batch


# --- streams ---------------------------------------------------------------------------------------------------------------------


def _folder(spark, name: str) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    return "file://" + tempfile.mkdtemp(prefix=f"{name}-")


@query("select event_id, user_id, user_id * 2 as doubled from events")
def stream_passthrough(spark, sf_dir):
    df = table(spark, sf_dir, "events", "event_id", "user_id")
    stream = spark.readStream.schema(df.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    r = StreamRunner(spark, chain(Task.columns("double", "doubled bigint", {"doubled": "user_id * 2"})), _folder(spark, "stream"))
    r.start(stream).awaitTermination()
    return r.read("double").select("event_id", "user_id", "doubled")


@query(
    f"""with recursive e as (select event_id, row_number() over (partition by event_id % 4 order by event_id) - 1 as pos, event_id % 4 as seq from events),
bs as (select seq, count(*) as rows from e group by 1), {_FIT.format(n=1000)},
placed as (select e.event_id, r.g, coalesce((select sum(b.rows) from bs b join r q on q.seq = b.seq where q.g = r.g and b.seq < e.seq), 0) + e.pos as place from e join r on r.seq = e.seq),
part as (select g, cast(place // 1000 as bigint) as p, event_id from placed),
num as (select g, p, row_number() over (order by g, p) - 1 as bid from (select distinct g, p from part))
select bid, {_EV} from part join num using (g, p) group by 1"""
)
def stream_maxrows(spark, sf_dir):
    """Four micro-batches accumulate across epochs and are cut like batches."""
    df = table(spark, sf_dir, "events", "event_id", "user_id")
    at = _folder(spark, "accumulate")
    for k in range(4):  # a file is a micro-batch
        df.where(F.pmod("event_id", F.lit(4)) == k).repartition(1).write.parquet(f"{at}/in/{k}")
    r = StreamRunner(spark, chain(Task.passthrough("group").with_mode(MaxRows(1000))), f"{at}/out", order_by=["event_id"], batched=True)
    r.start(FileStream(f"{at}/in/*", df.schema).with_source_buffer(1).load(spark)).awaitTermination()
    r.finish(3, df.schema)
    return r.read("group").groupBy(F.col(BATCH).alias("bid")).agg(F.count(F.lit(1)).alias("n_rows"), F.min("event_id").alias("lo_id"), F.max("event_id").alias("hi_id"))


# --- names, iteration and what graphs tell of themselves -------------------------------------------------------------------------

#: User columns with names that an engine might want for itself.
_NAMES = ("comp", "brank", "group", "first", "offset", "b2", "s2")
_ANY = ", ".join(f"user_id + {k} as {c if c not in ('group', 'first', 'offset') else chr(34) + c + chr(34)}" for k, c in enumerate(_NAMES))


def _clashing(spark, sf_dir, mode, b=None):
    df = table(spark, sf_dir, "events", "event_id", "user_id").selectExpr("event_id", *(f"user_id + {k} as `{c}`" for k, c in enumerate(_NAMES)))
    g = diamond(Task.passthrough("merge").with_mode(mode), _tagged("b", b), _tagged("c"), root=Task.passthrough("top"))
    return run(spark, g, FrameSource(df, "event_id", 64))


@query(f"select event_id, {_ANY} from events union all select event_id, {_ANY} from events")
def names_common_origin(spark, sf_dir):
    """Aligned branches that meet again, whatever their columns are called."""
    return _clashing(spark, sf_dir, COMMON_ORIGIN).frame("merge")


@query(f"select event_id, {_ANY} from events union all select event_id, {_ANY} from events")
def names_common_origin_asym(spark, sf_dir):
    return _clashing(spark, sf_dir, COMMON_ORIGIN, MaxRows(128)).frame("merge")


@query(f"select event_id, {_ANY} from events union all select event_id, {_ANY} from events")
def names_fanin_maxrows(spark, sf_dir):
    return _clashing(spark, sf_dir, MaxRows(200)).frame("merge")


@query(f"select 'merge' as sink, rn // 1000 as origin, cast(count(*) * 2 as bigint) as n_rows, cast(sum(user_id + 5) * 2 as bigint) as total from ({_RN}) group by 2")
def outputs_iterator(spark, sf_dir):
    """Every output batch, as the iterator gives it."""
    df = table(spark, sf_dir, "events", "event_id", "user_id").selectExpr("event_id", "user_id + 5 as b2")
    g = diamond(Task.passthrough("merge").with_mode(COMMON_ORIGIN), _tagged("b"), _tagged("c"), root=Task.passthrough("top"))
    rows = [(o.task, o.lineage.origins[0], o.data.num_rows, pc.sum(o.data.column("b2")).as_py()) for o in run(spark, g, FrameSource(df, "event_id", 1000)).outputs()]
    return spark.createDataFrame(rows, "sink string, origin bigint, n_rows bigint, total bigint")


@query(f"select rn // 64 as bid, {_EV} from ({_RN}) group by 1")
def common_origin_single(spark, sf_dir):
    """With one predecessor, or none, batches come as they are."""
    return _grouped(spark, events(spark, sf_dir, 64), COMMON_ORIGIN, COMMON_ORIGIN)


def _parts(batch: pa.Table) -> pa.Table:
    parts = in_batch.split(batch.select(["event_id"]), 30)
    return pa.table({"part_rows": pa.array([p.num_rows for p in parts], pa.int64()), "part_first": pa.array([p.column(0)[0].as_py() for p in parts], pa.int64())})


@query(f"select cast(count(*) as bigint) as part_rows, min(event_id) as part_first from ({_RN}) group by rn // 100, rn % 100 // 30")
def batch_split(spark, sf_dir):
    """Slices of a batch inside its function."""
    t = Task.batch("parts", "event_id bigint", "part_rows bigint, part_first bigint", _parts).with_drops("event_id", "user_id")
    return run(spark, chain(t), events(spark, sf_dir, 100)).frame("parts")


@query(f"select unnest(['top', 'b', 'b2', 'c', 'merge']) as task, n as runs, n as exec_ids from (select max(rn) // 64 + 1 as n from ({_RN}))")
def execution_ids(spark, sf_dir):
    """No two executions have one id."""
    r, out = _long(spark, sf_dir), None
    for n in r.graph.nodes():
        steps = r.compiled.batches(n.index).meta.select(F.element_at("path", -1).alias("s"))
        one = steps.agg(F.count(F.lit(1)).alias("runs"), F.countDistinct("s.exec_id").alias("exec_ids")).select(F.lit(n.name).alias("task"), "runs", "exec_ids")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"select unnest(['top', 'b', 'b2', 'c', 'merge']) as task, n as runs, n as sink_batches from (select max(rn) // 64 + 1 as n from ({_RN}))")
def tracker_summary(spark, sf_dir):
    """What a tracker adds up from the outputs alone."""
    r = _long(spark, sf_dir)
    tracker = r.tracker()
    for o in r.outputs():
        tracker.update(o)
    s = tracker.summary()
    return spark.createDataFrame([(t, x.runs, s.sink_batches) for t, x in s.tasks.items()], "task string, runs bigint, sink_batches bigint")


@query("select * from (values (1, 'a', 2, '150.0ms', '42.9%'), (2, 'b', 1, '200.0ms', '57.1%'), (3, 'TOTAL', null, '350.0ms', '100.0%')) t(line, task, runs, exec, share)")
def tracker_table(spark, sf_dir):
    """The printed table's rows."""
    tracker = PipelineTracker(["a", "b"])
    for i, (task, ms) in enumerate((("a", 100), ("b", 200), ("a", 50))):
        tracker.update(OutputBatch(pa.table({"x": [1]}), "sink", Lineage((i,), (PathStep(i, task, ms * 1_000_000),))))
    cells = [x.split() for x in tracker.table().splitlines()[3:] if "---" not in x]
    rows = [(k, c[0], int(c[1]) if len(c) == 6 else None, c[-4] if len(c) == 6 else c[1], c[-3] if len(c) == 6 else c[2]) for k, c in enumerate(cells, 1)]
    return spark.createDataFrame(rows, "line int, task string, runs int, exec string, share string")


@query("select * from (values (0, 'double', true, false, '', 'branch_a,branch_b'), (1, 'branch_a', false, false, 'double', 'merge_sink'), (2, 'branch_b', false, false, 'double', 'merge_sink'), (3, 'merge_sink', false, true, 'branch_a,branch_b', '')) t(idx, task, is_source, is_sink, before, after)")
def graph_introspection(spark, sf_dir):
    g = _demo()
    names = lambda at: ",".join(g.task(i).name for i in at)
    rows = [(n.index, n.name, n.is_source, n.is_sink, names(g.predecessors(n.index)), names(g.successors(n.index))) for n in g.nodes()]
    return spark.createDataFrame(rows, "idx int, task string, is_source boolean, is_sink boolean, before string, after string")


@query("select * from (values (0, 'merge_sink'), (1, 'branch_a'), (2, 'branch_b'), (3, 'double')) t(place, task)")
def graph_ranked_nodes(spark, sf_dir):
    g = _demo()
    return spark.createDataFrame([(k, g.task(i).name) for k, i in enumerate(g.ranked_nodes())], "place int, task string")


@query("select * from (values ('head', 'Pipeline: 4 tasks (1 source, 1 sink), 4 edges'), ('edge', 'double -> branch_a'), ('edge', 'double -> branch_b'), ('edge', 'branch_a -> merge_sink'), ('edge', 'branch_b -> merge_sink'), ('task', '[SOURCE] double'), ('task', '[      ] branch_a'), ('task', '[      ] branch_b'), ('task', '[SINK  ] merge_sink')) t(kind, line)")
def graph_summary(spark, sf_dir):
    lines = _demo().summary().splitlines()
    rows = [("head", lines[0]), *(("edge", x.strip()) for x in lines if " -> " in x), *(("task", x[2 : x.index("batch_mode")].strip()) for x in lines if "batch_mode" in x)]
    return spark.createDataFrame(rows, "kind string, line string")


@query("select * from (values ('a', 'int'), ('b', 'string'), ('c', 'double'), ('d', 'array<bigint>')) t(name, kind)")
def contract_schema(spark, sf_dir):
    """A contract written as text, as pairs and as a schema is one contract."""
    text, pairs = schema_of("a int, b string, c double, d array<bigint>"), schema_of([("a", "int"), ("b", "string"), ("c", "double"), ("d", "array<bigint>")])
    assert text == pairs == schema_of(text)
    return spark.createDataFrame([(n, t.simpleString()) for n, t in ColumnSet.of(text).items()], "name string, kind string")


@query("select * from (values ('plain', 'Passthrough', cast(null as int), 1, 0, ''), ('some', 'MaxRows(7)', 7, 4, 2, 'x')) t(task, mode, most, cpus, gpus, drops)")
def task_accessors(spark, sf_dir):
    """Tasks from a registry, with their modes, resources and drops."""
    registry = TaskRegistry()
    registry.register(Task.passthrough("plain"))
    registry.register(Task.passthrough("some").with_batch_size(7).with_resources(Resources(cpus=4, gpus=2)).with_drops("x"))
    tasks = [registry.build(n) for n in registry.task_names()]
    rows = [(t.name, repr(t.mode), t.mode.max_rows, t.resources.cpus, t.resources.gpus, ",".join(t.drops)) for t in tasks]
    return spark.createDataFrame(rows, "task string, mode string, most int, cpus int, gpus int, drops string")


@query("select 'memory' as policy, doc_id, n_chars from documents union all select 'none', doc_id, n_chars from documents")
def storage_policies(spark, sf_dir):
    out = None
    for policy in ("memory", "none"):
        r = run(spark, chain(Task.passthrough("top", _same), Task.passthrough("end").with_mode(MaxRows(300))), FrameSource(table(spark, sf_dir, "documents", "doc_id", "n_chars"), "doc_id", 500), storage=policy)
        one = r.frame("end").select(F.lit(policy).alias("policy"), "doc_id", "n_chars")
        out = one if out is None else out.unionByName(one)
    return out
