import json
import subprocess
import sys

import pytest
from dagspark import cli
from dagspark.model.graph import Graph
from dagspark.model.kinds import KINDS, NODE_TYPES, TAGS, describe, kind_of, ports_for
from dagspark.model.validate import validate


def doc(*kinds, edges=()):
    g = Graph()
    for i, k in enumerate(kinds):
        g.add_node(KINDS[k].create(f"n{i}"))
    d = g.to_dict()
    d["edges"] = list(edges)
    return d


def codes(d):
    return [f["code"] for f in validate(d)["findings"]]


def test_registry():
    assert len(KINDS) == 31
    for d in describe():
        assert d["node_type"] in NODE_TYPES
        for side in d["ports"].values():
            assert all(p["data_kind"] in TAGS for p in side)
        json.dumps(d)
    for k in KINDS.values():
        assert k.create().ports == k.ports
        assert kind_of(k.create()).key == k.key


def test_ports_of_stages_and_sources():
    assert ports_for("analyzer", {"si_stage": "si_sort"}) == ports_for("analyzer", {"si_stage": "sort"})
    assert not ports_for("custom_code", {"has_data_input": False}).inputs
    assert len(ports_for("preprocessor", {"processor_type": "split"}).outputs) == 4
    with pytest.raises(ValueError, match="unknown node type"):
        ports_for("nothing")


def edge(a, b, ap=None, bp=None):
    return {"source": a, "source_port": ap, "target": b, "target_port": bp}


@pytest.mark.parametrize(
    ("document", "code"),
    [
        ({"nodes": []}, "malformed_nodes"),
        ({"nodes": {"a": 1}}, "malformed_node"),
        ({"nodes": {"a": {"node_type": "data_loader"}}}, "missing_node_id"),
        ({"nodes": {"a": {"id": "b", "node_type": "data_loader"}}}, "node_id_mismatch"),
        ({"nodes": {"a": {"id": "a", "node_type": "what"}}}, "unknown_node_type"),
        ({"nodes": {"a": {"id": "a", "node_type": "data_loader", "parameters": []}}}, "malformed_parameters"),
        ({"nodes": {"a": {"id": "a", "node_type": "custom_code", "parameters": {"module": {"name": "module", "value": "/no/such.py"}}}}}, "missing_module_path"),
        (doc("data_loader") | {"edges": {}}, "malformed_edges"),
        (doc("data_loader", edges=[1]), "malformed_edge"),
        (doc("data_loader", edges=[{"source": "n0"}]), "malformed_edge"),
        (doc("data_loader", edges=[["n0", "gone"]]), "dangling_edge"),
        (doc("preprocessor_normalize", edges=[["n0", "n0"]]), "self_loop"),
        (doc("data_loader", "preprocessor_normalize", edges=[edge("n0", "n1", "nope")]), "unknown_port"),
        (doc("preprocessor_split", "visualizer", edges=[["n0", "n1"]]), "ambiguous_port"),
        (doc("neural_loader_eeg", "preprocessor_normalize", edges=[["n0", "n1"]]), "incompatible_data_kind"),
        (doc("neural_loader_spike", "preprocessor_neural_filter", edges=[["n0", "n1"]]), "incompatible_signal_type"),
        (doc("data_loader", "preprocessor_normalize", edges=[["n0", "n1"], ["n0", "n1"]]), "duplicate_edge"),
        (doc("data_loader", "data_loader", "preprocessor_normalize", edges=[["n0", "n2"], ["n1", "n2"]]), "several_edges_on_input"),
        (doc("preprocessor_normalize"), "unconnected_required_input"),
        ({"nodes": {}}, "empty_pipeline"),
        (doc("preprocessor_normalize", "preprocessor_normalize", edges=[["n0", "n1"], ["n1", "n0"]]), "cycle_detected"),
    ],
)
def test_finding(document, code):
    assert code in codes(document)


def test_valid_chain_and_version_0():
    d = doc("data_loader", "preprocessor_normalize", "visualizer", edges=[["n0", "n1"], ["n1", "n2"]])
    assert codes(d) == []
    del d["version"]
    assert validate(d)["file_schema_version"] == 0
    again = Graph.from_dict(d).to_dict()
    assert again["version"] == 1
    assert again["edges"][0] == edge("n0", "n1")
    assert Graph.from_dict(again).to_dict() == again


def test_order_edits_and_connections():
    g = Graph()
    for n, k in (("c", "visualizer"), ("a", "data_loader"), ("b", "preprocessor_normalize"), ("x", "data_loader")):
        g.add_node(KINDS[k].create(n))
    assert g.can_connect("a", "b") is None
    assert g.add_edge("a", "b")
    assert not g.add_edge("a", "b")
    assert not g.add_edge("a", "gone")
    g.add_edge("b", "c")
    assert [n for n in g.order()[0] if n != "x"] == ["a", "b", "c"]
    assert g.can_connect("b", "b") == "self_loop"
    g.apply({"type": "add_edge", "edge": edge("x", "b")})
    assert [e.source for e in g.incoming("b")] == ["x"]
    g.apply({"type": "set_param", "node_id": "b", "name": "method", "value": "zscore"})
    assert g.nodes["b"].param("method") == "zscore"
    g.apply({"type": "delete_node", "node_id": "b"})
    assert not g.edges


def test_deep_chain_is_quick():
    import time

    g = Graph()
    for i in range(400):
        g.add_node(KINDS["preprocessor_normalize" if i else "data_loader"].create(f"n{i}"))
        if i:
            g.add_edge(f"n{i - 1}", f"n{i}")
    d = g.to_dict()
    start = time.perf_counter()
    assert validate(d)["valid"]
    assert time.perf_counter() - start < 0.5


def test_model_needs_no_spark():
    code = "import sys; import dagspark.cli, dagspark.model.validate; sys.exit('pyspark' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], check=False).returncode == 0


def test_cli_errors(tmp_path, capsys):
    assert cli.main(["validate", str(tmp_path / "none.pipeline")]) == 1
    assert json.loads(capsys.readouterr().out)["code"] == "file_not_found"
    bad = tmp_path / "bad.pipeline"
    bad.write_text("{")
    assert cli.main(["validate", str(bad)]) == 1
    assert json.loads(capsys.readouterr().out)["code"] == "invalid_json"
    bad.write_text("[]")
    assert cli.main(["validate", str(bad)]) == 1
    assert json.loads(capsys.readouterr().out)["code"] == "malformed_document"
    good = tmp_path / "good.pipeline"
    good.write_text(json.dumps(doc("data_loader")))
    assert cli.main(["validate", str(good)]) == 0
    capsys.readouterr()
    assert cli.main(["codegen", str(good)]) == 0
    compile(json.loads(capsys.readouterr().out)["code"], "generated", "exec")
    assert cli.main(["describe"]) == 0
    assert len(json.loads(capsys.readouterr().out)["node_kinds"]) == 31
    assert cli.main(["similar"]) == 2
