"""Progress of every node of a run, and what writing nodes do in their turn."""

import json

import pytest

from dagspark.model.graph import Graph
from dagspark.model.kinds import KINDS, Param
from dagspark.plans import runner
from dagspark.plans.compiler import Context, compile_graph


def chain(tmp_path, *kinds, **params):
    g = Graph({"pyspark": "4"})
    for i, k in enumerate(kinds):
        n = KINDS[k].create(f"n{i}")
        for name, v in params.get(f"n{i}", {}).items():
            n.parameters.setdefault(name, Param(name)).value = v
        g.add_node(n)
        if i:
            g.add_edge(f"n{i - 1}", f"n{i}")
    path = tmp_path / "p.pipeline"
    g.save(str(path))
    return str(path), g


def table(tmp_path, rows=30):
    (tmp_path / "t.csv").write_text("a,b\n" + "\n".join(f"{i},{i * i % 7 if i % 5 else ''}" for i in range(rows)))
    return {"file_path": str(tmp_path / "t.csv")}


def states(events):
    return [(e["node_id"], e["state"], e.get("rows")) for e in events if e["state"] != "pending"]


def test_every_node_tells_its_state_and_rows_in_order(spark, tmp_path):
    path, _ = chain(tmp_path, "data_loader", "preprocessor_missing", "analyzer_correlation", n0=table(tmp_path), n1={"strategy": "drop"})
    events = []
    assert runner.run(spark, path, progress=events.append)["status"] == "ok"
    assert [e["node_id"] for e in events[:3]] == ["n0", "n1", "n2"]
    assert all(e["state"] == "pending" for e in events[:3])
    assert states(events) == [("n0", "running", None), ("n1", "running", None), ("n2", "running", None), ("n0", "ok", 30), ("n1", "ok", 24), ("n2", "ok", 2)]


def test_a_node_that_cannot_be_compiled_has_the_error(spark, tmp_path):
    path, _ = chain(tmp_path, "data_loader", "preprocessor_neural_filter", "visualizer", n0=table(tmp_path), n1={"low_hz": 50, "high_hz": 10})
    events = []
    made = runner.run(spark, path, progress=events.append)
    assert made["status"] == "error"
    assert states(events) == [("n0", "running", None), ("n1", "running", None), ("n1", "error", None)]
    assert "low" in next(e["message"] for e in events if e["state"] == "error")


def test_a_node_whose_rows_cannot_be_made_has_the_error(spark, tmp_path):
    (tmp_path / "user.py").write_text("from pyspark.sql import functions as F\ndef broken(df):\n    return df.withColumn('c', F.raise_error(F.lit('no such luck')))\n")
    path, _ = chain(tmp_path, "data_loader", "custom_code", "visualizer", n0=table(tmp_path), n1={"function_name": "broken", "module": str(tmp_path / "user.py")})
    events = []
    made = runner.run(spark, path, progress=events.append, allow_code=True)
    assert made["status"] == "error"
    assert "no such luck" in made["error"]
    assert states(events)[-1] == ("n1", "error", None)


def test_writing_nodes_write_when_run_and_not_before(spark, tmp_path):
    out = tmp_path / "phy"
    g = Graph({"pyspark": "4"})
    for name, kind, more in (("load", "neural_loader_spike", table(tmp_path)), ("sort", "analyzer_neural_si_sort", {}), ("export", "analyzer_neural_si_export", {"output_path": str(out), "method": "report"})):
        n = KINDS[kind].create(name)
        for k, v in more.items():
            n.parameters.setdefault(k, Param(k)).value = v
        g.add_node(n)
    g.add_edge("load", "sort")
    g.add_edge("sort", "export")
    plan = compile_graph(g, Context(spark))
    assert list(plan.actions) == ["export"]
    assert not out.exists()
    plan.release()
    g.save(str(tmp_path / "e.pipeline"))
    events = []
    made = runner.run(spark, str(tmp_path / "e.pipeline"), progress=events.append)
    assert made["status"] == "ok", made["error"]
    assert out.exists()
    assert {n: s for n, s, _ in states(events)} == {"load": "ok", "sort": "ok", "export": "ok"}


def test_montages_and_events_are_checked(spark, tmp_path):
    for kind, bad in (("preprocessor_neural_montage", {"montage": "nowhere"}), ("analyzer_neural_epochs", {"event_id": "one"}), ("preprocessor_neural_ica", {"montage": "nowhere"})):
        _, g = chain(tmp_path, "data_loader", kind, n0=table(tmp_path), n1=bad)
        with pytest.raises(ValueError):
            compile_graph(g, Context(spark))
    assert json.loads((tmp_path / "p.pipeline").read_text())
