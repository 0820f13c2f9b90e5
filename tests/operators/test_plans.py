"""Layers and issues of plans against brute force."""

import random

import pytest

from quarry.operators import routing as G


def brute(nodes, edges):
    known = set(nodes)
    needs = {n: {(p, d) for p, i, d in edges if (p, i) == n and (p, d) in known} for n in known}
    out, depth = {}, 0
    while ready := [n for n in known if n not in out and needs[n] <= out.keys()]:
        out.update(dict.fromkeys(ready, depth))
        depth += 1
    return {n: out.get(n, -1) for n in known}


@pytest.mark.parametrize("most", [100_000, 12])
def test_layers_and_issues_of_many_plans(spark, monkeypatch, most):
    """Plans in one pass, those above the bound by joins: the same layers."""
    monkeypatch.setattr(G, "PLAN_ROWS", most)
    draw = random.Random(3)
    nodes = [(p, f"s{i}") for p in range(60) for i in range(draw.randrange(1, 9)) for _ in range(draw.choice([1, 1, 1, 2]))]
    edges = [(p, i, f"s{draw.randrange(10)}") for p, i in nodes for _ in range(draw.randrange(2))]
    nodes += [(99, f"s{i}") for i in range(20)]
    edges += [(99, f"s{i}", f"s{i - 1}") for i in range(1, 20)] + [(99, "s3", None), (98, "s1", "s2")]
    a, b = spark.createDataFrame(nodes, "plan long, id string"), spark.createDataFrame(edges, "plan long, id string, needs string")
    want = brute(nodes, edges)
    got = G.layers(a, b).collect()
    assert len(got) == len(want) and {(r.plan, r.id): r.layer for r in got} == want and max(want.values()) == 19 and -1 in want.values()
    own = {}
    for p, i, d in edges:
        own.setdefault((p, i), []).append(d)
    steps = [(p, i, " " if i == "s2" else "q", own.get((p, i), [])) for p, i in nodes]
    issues = {(p, i, "duplicate_id") for p, i in nodes if nodes.count((p, i)) > 1} | {(p, i, "empty_question") for p, i in nodes if i == "s2"} | {(*n, "cycle") for n, x in want.items() if x < 0}
    issues |= {(p, i, "unknown_dependency") for p, i, d in edges if (p, i) in want and (p, d) not in want}
    found = [tuple(r) for r in G.plan_issues(spark.createDataFrame(steps, "plan long, id string, question string, depends_on array<string>")).select("plan", "id", "issue").collect()]
    assert len(found) == len(issues) and set(found) == issues


def test_layers_take_one_pass(spark, small):
    """Each layer was three joins over all steps."""
    from quarry.registry import QUERIES

    for name in ("topo_layers", "subplan_issues"):
        assert "Join" not in QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()


def test_too_deep_plans_raise(spark):
    n = spark.createDataFrame([(1, i) for i in range(6)], "plan long, id int")
    e = spark.createDataFrame([(1, i, i - 1) for i in range(1, 6)], "plan long, id int, needs int")
    assert G.layers(n, e, 5).where("layer = 5").count() == 1
    with pytest.raises(Exception, match="deeper than 4 layers"):
        G.layers(n, e, 4).count()
