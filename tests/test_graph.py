import pytest

from millrace.plans.contracts import schema_of
from millrace.plans.errors import GraphError, SchemaMismatch
from millrace.plans.graph import PipelineGraph
from millrace.plans.task import COMMON_ORIGIN, MaxRows, Resources, Task, TaskRegistry

SOURCE = schema_of([("id", "bigint")])


def linear(*tasks):
    g = PipelineGraph()
    g.add_linear(tasks)
    return g


def test_additive_contracts_hold():
    g = linear(Task.columns("a", "x int", requires="id bigint"), Task.columns("b", "y int", requires="x int, id bigint"))
    assert set(g.validate(SOURCE)[1]) == {"id", "x", "y"}


@pytest.mark.parametrize(
    "tasks",
    [
        [Task.columns("a", requires="nope int")],
        [Task.passthrough("a").with_drops("nope")],
        [Task.passthrough("a").with_drops("id"), Task.columns("b", requires="id bigint")],
    ],
)
def test_broken_contracts_are_refused(tasks):
    with pytest.raises(SchemaMismatch):
        linear(*tasks).validate(SOURCE)


def test_a_merge_keeps_what_branches_share():
    g = PipelineGraph()
    for n in "bc":
        g.add_task(Task.columns(n, f"from_{n} double"))
    m = g.add_task(Task.columns("m", requires="from_b double"))
    g.add_edge(0, m)
    g.add_edge(1, m)
    with pytest.raises(SchemaMismatch):
        g.validate(SOURCE)


def test_cycles_loops_doubles_and_names():
    g = linear(Task.passthrough("a"), Task.passthrough("b"))
    for a, b in ((1, 0), (0, 0), (0, 1), (0, 7)):
        with pytest.raises(GraphError):
            g.add_edge(a, b)
    assert g.edges == [(0, 1)]
    with pytest.raises(GraphError):
        g.add_task(Task.passthrough("a"))
    with pytest.raises(GraphError, match="no source"):
        PipelineGraph().validate(SOURCE)


def test_ranks_and_introspection():
    g = linear(*map(Task.passthrough, "abc"))
    assert g.rank_from_sink() == {0: 2, 1: 1, 2: 0}
    assert g.ranked_nodes() == [2, 1, 0]
    assert (g.source_tasks(), g.sink_tasks(), g.predecessors(1), g.successors(1), g.out_degree(2)) == ([0], [2], [0], [2], 0)
    lone = linear(Task.passthrough("x")).node(0)
    assert lone.is_source and lone.is_sink
    assert repr(g) == "Pipeline(3 tasks, 2 edges, 1 source, 1 sink)"


def test_rank_is_the_longest_of_shortest_ways():
    g = PipelineGraph()
    a, b, s, t = (g.add_task(Task.passthrough(n)) for n in "abst")
    for e in ((a, s), (a, b), (b, t), (b, s)):
        g.add_edge(*e)
    assert g.rank_from_sink() == {a: 2, b: 1, s: 0, t: 0}


def test_summary_names_everything():
    g = linear(Task.passthrough("a").with_resources(Resources(cpus=2, gpus=1)), Task.passthrough("b").with_mode(MaxRows(3)))
    text = g.summary()
    assert text.startswith("Pipeline: 2 tasks (1 source, 1 sink), 1 edges")
    assert "[SOURCE] a" in text and "batch_mode=MaxRows(3)" in text and "(cpus=2, gpus=1)" in text and "  a -> b" in text and "b               rank=0" in text


def test_max_rows_of_nothing_is_refused():
    for make in (lambda: MaxRows(0), lambda: Task.passthrough("a").with_batch_size(0)):
        with pytest.raises(ValueError, match=r"MaxRows\(0\) is invalid"):
            make()
    assert MaxRows(4).max_rows == 4 and COMMON_ORIGIN.max_rows is None


def test_registry():
    g = linear(Task.passthrough("a"), Task.passthrough("b"))
    r = TaskRegistry(g)
    assert r.task_names() == ["a", "b"] and r.build("a").name == "a"
    again = Task.columns("a", "x int")
    r.register(again)
    assert r.build("a") is again
    with pytest.raises(GraphError, match="task 'z' not found in registry"):
        r.build("z")
