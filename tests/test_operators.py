import json

import numpy as np
import pandas as pd
import pytest
from dagspark.model.graph import Graph
from dagspark.model.kinds import KINDS, Param
from dagspark.operators import learn, signal, sorting, spikes, tabular
from dagspark.operators.tabular import ROW
from dagspark.plans import providers, receipt, runner
from dagspark.plans.compiler import CompileError, Context, compile_graph
from dagspark.search import index, rank, scan
from dagspark.sources import tables
from dagspark.streaming.spikes import event_counts
from pyspark.sql import functions as F


def frame(spark, parts=1, **columns):
    pdf = pd.DataFrame({ROW: range(len(next(iter(columns.values())))), **columns})
    return spark.createDataFrame(pdf).repartition(parts)


def back(df):
    return df.toPandas().sort_values(ROW).reset_index(drop=True)


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_tabular_any_partitioning(spark, parts):
    x = [1.0, None, 3.0, None, None, 6.0, 2.0, 9.0]
    df = frame(spark, parts, x=x, y=[5.0] * 8)
    s = pd.Series(x)
    assert np.allclose(back(tabular.normalize(df, "minmax"))["x"], (s - s.min()) / (s.max() - s.min()), equal_nan=True)
    assert back(tabular.normalize(df, "minmax"))["y"].isna().all()
    assert np.allclose(back(tabular.normalize(df, "zscore"))["x"], (s - s.mean()) / s.std(), equal_nan=True)
    assert np.allclose(back(tabular.normalize(df, "robust"))["x"], (s - s.median()) / (s.quantile(0.75) - s.quantile(0.25)), equal_nan=True)
    assert back(tabular.forward_fill(df, 3))["x"].tolist() == s.ffill().tolist()
    assert back(tabular.fill_missing(df, "median"))["x"].tolist() == s.fillna(s.median()).tolist()
    assert len(back(tabular.fill_missing(df, "drop"))) == 5
    assert tabular.select_variance(df).columns == [ROW, "x"]


def test_leading_gap_stays(spark):
    assert np.isnan(back(tabular.forward_fill(frame(spark, x=[None, 2.0, None])))["x"][0])


def test_empty_table(spark):
    df = frame(spark, x=[1.0]).where("false")
    for method in ("minmax", "zscore", "robust"):
        assert tabular.normalize(df, method).count() == 0
    assert spikes.psth(df.withColumnRenamed("x", "time")).count() == 0
    assert learn.regression(df.withColumn("y", F.lit(1.0))).count() == 0


def test_row_ids_are_dense(spark):
    df = tabular.with_row_id(spark.range(0, 1000, 1, 7).toDF("v"))
    assert sorted(r[ROW] for r in df.collect()) == list(range(1000))


def test_split_is_a_partition(spark):
    df = frame(spark, 3, a=np.arange(101.0), t=np.arange(101.0))
    parts = tabular.split(df, 0.2, 42)
    assert parts["X_test"].count() == 21
    assert parts["X_train"].count() == 80
    assert parts["X_test"].join(parts["X_train"], ROW).count() == 0
    assert parts["y_test"].columns == [ROW, "t"]


def test_kbest(spark):
    rng = np.random.default_rng(0)
    y = np.repeat([0, 1, 2], 30)
    df = frame(spark, 2, noise=rng.normal(size=90), good=y + rng.normal(size=90) / 9, y=y)
    assert tabular.select_kbest(df, 1).columns == [ROW, "good", "y"]


def test_correlation_guards_constants(spark):
    df = frame(spark, a=[1.0, 2.0, 3.0], b=[2.0, 4.0, 6.5], c=[1.0, 1.0, 1.0])
    got = tabular.correlation(df).toPandas().set_index("column")
    assert got.loc["a", "b"] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4, 6.5])[0, 1])
    assert np.isnan(got.loc["a", "c"])


def test_regressions_against_closed_forms(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 2))
    y = x @ [2.0, -1.0] + 3 + rng.normal(size=60)
    df = frame(spark, 3, a=x[:, 0], b=x[:, 1], y=y)
    full = np.column_stack([x, np.ones(60)])
    assert np.allclose(back(learn.regression(df))["prediction"], full @ np.linalg.lstsq(full, y, rcond=None)[0])
    c = x - x.mean(0)
    w = np.linalg.solve(c.T @ c + np.eye(2), c.T @ (y - y.mean()))
    assert np.allclose(back(learn.regression(df, "ridge"))["prediction"], c @ w + y.mean())
    poly = np.column_stack([x, x[:, 0] ** 2, x[:, 0] * x[:, 1], x[:, 1] ** 2, np.ones(60)])
    assert np.allclose(back(learn.regression(df, "polynomial"))["prediction"], poly @ np.linalg.lstsq(poly, y, rcond=None)[0])


def blobs():
    rng = np.random.default_rng(2)
    return np.concatenate([rng.normal(c, 0.1, (20, 2)) for c in ((0, 0), (5, 5), (0, 5))])


def groups(labels):
    return [set(labels[i : i + 20]) for i in (0, 20, 40)]


def test_clusterings_find_the_blobs(spark):
    x = blobs()
    df = frame(spark, 3, a=x[:, 0], b=x[:, 1])
    for labels in (learn.kmeans(df, 3), learn.dbscan(df, 0.5, 4), learn.hierarchical(df, 3)):
        found = groups(back(labels)["label"].tolist())
        assert all(len(g) == 1 for g in found)
        assert len(set.union(*found)) == 3


def test_dbscan_against_brute_force(spark):
    x = np.random.default_rng(3).random((120, 2))
    got = back(learn.dbscan(frame(spark, 2, a=x[:, 0], b=x[:, 1]), 0.09, 5))["label"].to_numpy()
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= 0.09**2
    core = near.sum(1) >= 5
    want = np.full(120, -1)
    label = 0
    for i in range(120):
        if core[i] and want[i] < 0:
            todo = [i]
            while todo:
                j = todo.pop()
                if want[j] < 0:
                    want[j] = label
                    if core[j]:
                        todo += list(np.flatnonzero(near[j]))
            label += 1
    assert (got[core] == want[core]).all()
    assert ((got == -1) == (want == -1)).all()


def test_spikes(spark):
    t = [0.01, 0.02, 0.11, 0.12, 0.13]
    assert spikes.psth(frame(spark, time=t), 0.1, 0, 0.2).orderBy("bin_center").toPandas()["count"].tolist() == [2.0, 3.0]
    assert spikes.isi_histogram(frame(spark, time=[0, 0.1, 0.2, 0.3, 0.4]), 10, 0.2).agg(F.sum("count")).first()[0] == 4
    assert spikes.psth(frame(spark, time=[0.05, 0.06], unit=["b", "a"]), 0.1).columns == ["bin_center", "unit_b", "unit_a"]
    with pytest.raises(ValueError, match="positive"):
        spikes.psth(frame(spark, time=t), 0)


def test_psth_bins_as_numpy_does(spark):
    t = np.round(np.random.default_rng(4).random(500) * 3, 2)
    got = spikes.psth(frame(spark, 3, time=t), 0.05, 0, 3.0).orderBy("bin_center").toPandas()["count"].to_numpy()
    edges = 0 + np.arange(61) * 0.05
    assert (got == np.histogram(t, edges)[0]).all()


def test_calcium(spark):
    x = [10.0] * 50
    x[30:35] = [20.0] * 5
    got = back(spikes.dff(frame(spark, a=x)))["a"]
    assert got[29] == 0
    assert got[31] == 1
    y = [0.0] * 100
    y[40] = y[70] = 10.0
    events = spikes.threshold_events(frame(spark, 5, a=y), 3, 10).toPandas()
    assert events["time"].tolist() == [4.0, 7.0]


def tone(hz, n, rate=250):
    return np.sin(2 * np.pi * hz * np.arange(n) / rate)


def test_filter_and_spectrum(spark):
    df = frame(spark, 3, ch0=tone(10, 500))
    rms = lambda x: float(np.sqrt((back(x)["ch0"] ** 2).mean()))
    inside, outside = rms(signal.bandpass(df, 250, 8, 12)), rms(signal.bandpass(df, 250, 30, 40))
    assert inside > 0.3
    assert outside < inside / 3
    psd = signal.welch(frame(spark, 3, ch0=tone(20, 1000)), 250, 256).toPandas()
    assert abs(psd.loc[psd["ch0"].idxmax(), "frequency"] - 20) < 2


def test_welch_against_numpy(spark):
    x = np.random.default_rng(5).normal(size=777)
    w = np.hanning(64)
    p = np.mean([np.abs(np.fft.rfft(x[s : s + 64] * w)) ** 2 for s in range(0, 777 - 63, 32)], axis=0) / (250 * (w**2).sum())
    p[1:-1] *= 2
    got = signal.welch(frame(spark, 4, a=x), 250, 64).orderBy("frequency").toPandas()["a"]
    assert np.allclose(got, p, atol=1e-12)


def test_erp_and_ica(spark):
    v = np.zeros(100)
    v[[20, 60]] = 4
    stim = np.zeros(100)
    stim[[20, 60]] = 1
    got = signal.erp(frame(spark, a=v, stim=stim), 10, -0.5, 0.5, "stim").orderBy("time").toPandas()
    assert got["a"].iloc[5] == pytest.approx(4 - 4 / 6)
    middle = signal.erp(frame(spark, a=v), 10, 0, 0.1).toPandas()
    assert len(middle) == 2
    x = np.random.default_rng(6).random((400, 2)) @ np.array([[1, 0.4], [0.2, 1]])
    again = back(signal.ica(frame(spark, 2, a=x[:, 0], b=x[:, 1])))
    assert np.allclose(again[["a", "b"]], x, atol=1e-8)


def test_sorting(spark):
    rng = np.random.default_rng(7)
    truth = np.sort(rng.choice(29000, 40, replace=False)) + 100
    truth = truth[np.append(True, np.diff(truth) > 20)]
    x = rng.normal(size=30000)
    x[truth] -= 30
    rec = frame(spark, 3, c0=x, c1=rng.normal(size=30000))
    found = sorting.sort_simple(rec, 8.0)
    assert {r.sample_index for r in found.where("unit_id = 'c0'").collect()} == set(truth.tolist())
    other = found.withColumn("sample_index", F.col("sample_index") + 3)
    best = sorting.best_matches(sorting.compare(found, other, 30000.0)).toPandas()
    assert best["agreement"].tolist() == [1.0]
    metrics = sorting.quality_metrics(found, 30000.0, 1.0, rec).toPandas()
    assert metrics["snr"].iloc[0] > 8
    white = back(sorting.whiten(rec))[["c0", "c1"]].to_numpy()
    assert np.allclose(np.cov(white.T, bias=True), np.eye(2), atol=1e-6)
    ref = back(sorting.common_reference(rec))
    assert np.allclose(ref["c0"], -ref["c1"])
    with pytest.raises(sorting.AdapterMissing):
        sorting.sort_spikes(rec, "kilosort4")


def test_analyzer_from_recording_to_export(spark, tmp_path):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(9000, 2))
    at = np.arange(30, 8900, 60)
    x[at[::2], 0] -= 40 + 3 * rng.normal(size=len(at[::2]))
    x[at[1::2], 1] -= 30 + 3 * rng.normal(size=len(at[1::2]))
    rec = frame(spark, 3, c0=x[:, 0], c1=x[:, 1])
    analyzer = sorting.analyze(rec, sorting.sort_simple(rec, 8.0))
    assert set(analyzer.extensions) == {"random_spikes", "waveforms", "templates", "noise_levels"}
    assert set(sorting.analyze(rec, analyzer.sorting, "noise_levels").extensions) == {"noise_levels"}
    with pytest.raises(sorting.AdapterMissing):
        sorting.analyze(rec, analyzer.sorting, "spike_locations")
    measured = sorting.analyzer_metrics(analyzer, 30000.0)
    got = {r.unit_id: r for r in measured.metrics.collect()}
    # brute force of the isolation distance, by amplitudes on both channels
    of = {u: x[[r.sample_index for r in analyzer.sorting.where(F.col("unit_id") == u).collect()]] for u in ("c0", "c1")}
    for u, v in (("c0", "c1"), ("c1", "c0")):
        gap = of[v] - of[u].mean(0)
        d2 = np.sort(np.einsum("ij,jk,ik->i", gap, np.linalg.inv(np.cov(of[u].T)), gap))
        want = d2[len(of[u]) - 1] if len(of[v]) >= len(of[u]) else None
        assert got[u].isolation_distance == (want if want is None else pytest.approx(want))
    assert set(sorting.analyzer_metrics(analyzer, 30000.0, "firing_rate").metrics.columns) == {"unit_id", "firing_rate"}
    kept = sorting.curate_analyzer(measured, 30000.0, snr_min=35.0, presence_ratio_min=0.5)
    assert {r.unit_id for r in kept.select("unit_id").distinct().collect()} == {"c0"}
    assert {r.unit_id for r in kept.metrics.collect()} == {r.unit_id for r in kept.extensions["templates"].select("unit_id").collect()} == {"c0"}
    path = sorting.export(kept, str(tmp_path / "phy"))
    assert spark.read.option("header", True).csv(f"{path}/spikes").count() == kept.count()
    assert spark.read.option("header", True).csv(f"{path}/cluster_metrics").count() == 1


def test_curate(spark):
    m = spark.createDataFrame([("u1", 8.0, 0.01, 0.95, 5.0), ("u2", 2.0, 0.5, 0.2, 0.01), ("u3", float("nan"), 0.0, 1.0, 5.0)], "unit string, snr double, isi_violations_ratio double, presence_ratio double, firing_rate double")
    assert [r.unit for r in sorting.curate(m).collect()] == ["u1"]


def test_sources(spark, tmp_path):
    np.save(tmp_path / "s.npy", np.array([0.01, 0.05, 0.12]))
    assert tables.load_signal(spark, str(tmp_path / "s.npy"), "spike", "npy").columns == [ROW, "time"]
    (tmp_path / "e.csv").write_text("ch0,ch1\n1.5,2\n3,4\n")
    assert tables.load_signal(spark, str(tmp_path / "e.csv"), "eeg").count() == 2
    x = np.arange(30, dtype="int16").reshape(10, 3)
    x.tofile(tmp_path / "r.bin")
    assert (back(tables.load_binary_recording(spark, str(tmp_path / "r.bin"), 3)).drop(columns=ROW).to_numpy() == x).all()
    with pytest.raises(tables.SourceError):
        tables.load_signal(spark, str(tmp_path / "x.nwb"), "eeg")
    assert tables.resolve("s3://b/k") == "s3a://b/k"


def pipeline(tmp_path, *kinds, **params):
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


def test_run_writes_receipt_and_figure(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,2\n3,4\n")
    path, _ = pipeline(tmp_path, "data_loader", "preprocessor_normalize", "visualizer", n0={"file_path": str(tmp_path / "t.csv")})
    events = []
    made = runner.run(spark, path, progress=events.append)
    assert made["status"] == "ok"
    assert len(made["figures"]) == 1
    assert json.loads(open(made["receipt_path"]).read())["inputs"][0]["sha256"]
    assert [e["state"] for e in events][-1] == "ok"
    assert made["environment_warnings"] == []


def test_missing_file_fails_the_run(spark, tmp_path):
    path, _ = pipeline(tmp_path, "data_loader", "visualizer", n0={"file_path": str(tmp_path / "none.csv")})
    made = runner.run(spark, path)
    assert made["status"] == "error"
    assert "none.csv" in made["error"]


def test_every_table_node_compiles(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,c\n" + "\n".join(f"{i},{i * i % 7},{i % 3}" for i in range(30)))
    for kind in ("preprocessor_normalize", "preprocessor_missing", "preprocessor_split", "preprocessor_feature_select", "preprocessor_neural_filter", "preprocessor_neural_montage", "preprocessor_neural_ica", "analyzer_correlation", "analyzer_clustering", "analyzer_regression", "analyzer_neural_spectrum", "analyzer_neural_epochs", "analyzer_neural_spike", "analyzer_neural_calcium"):
        _, g = pipeline(tmp_path, "data_loader", kind, n0={"file_path": str(tmp_path / "t.csv")}, n1={"sampling_rate": 20} if kind == "analyzer_neural_epochs" else {})
        plan = compile_graph(g, Context(spark))
        for df in plan.outputs["n1"].values():
            assert df.count() > 0, kind
        plan.release()


def test_compiler_rejects_open_inputs_and_code(spark, tmp_path):
    _, g = pipeline(tmp_path, "preprocessor_normalize")
    with pytest.raises(CompileError):
        compile_graph(g, Context(spark))


def test_model_call(spark):
    class Echo:
        def complete(self, prompt, model):
            return prompt

    df = frame(spark, a=list(range(30)))
    reply = providers.call("echo", "hi", "m", df, {"echo": Echo()})
    assert reply.startswith("hi\n\n")
    assert "(30 rows total)" in reply
    assert providers.preview(None) == ""
    with pytest.raises(providers.ProviderError):
        providers.call("none", "hi", "m", None, {})


def test_environment_pins():
    assert receipt.mismatches({"python": ">=3.0", "pyspark": "4"}, {"python": "3.13.1", "pyspark": "4.1.2"}) == []
    assert len(receipt.mismatches({"python": "2", "gone": "1"}, {"python": "3.13.1"})) == 2


LIBRARY = '''"""Signals."""
import numpy as np
from scipy import signal


def band_limited(data: np.ndarray, low: float = 1.0):
    """Bandpass filter of an EEG recording."""
    sos = signal.butter(4, [low, 40], btype="band", output="sos")
    return signal.sosfilt(sos, data)


def count_words(text: str) -> int:
    """Number of words."""
    return len(text.split())


def load(path: str):
    """Load a table from a file."""
    return np.loadtxt(path)


def _private(x):
    return x


class Tool:
    def psth(self, spikes: list) -> list:
        """PSTH of spikes."""
        return np.histogram(spikes)


# bandpass the recording
sos = signal.butter(4, [1, 40], output="sos")
clean = signal.sosfilt(sos, [1.0])
'''


def test_text_columns_become_numbers_for_kernels(spark):
    df = spark.createDataFrame([(0, "1.5", "x"), (1, "2.5", "y"), (2, "3.5", "4")], f"{ROW} long, a string, b string")
    got = back(spikes.dff(df, 50))
    assert got["a"].tolist() == pytest.approx([-0.4, 0.0, 0.4])


def test_code_as_a_query():
    assert index.code_calls("y = signal.butter(4, x)") == ["signal.butter"]
    assert index.code_calls("bandpass filter") == []
    assert index.code_calls("broken (") == []


def test_registered_roots(tmp_path):
    path = str(tmp_path / "known.json")
    tables.save_repositories(path, [{"id": "a", "path": str(tmp_path)}])
    assert index.roots(None, str(tmp_path), path) == [str(tmp_path)]
    assert tables.load_repositories(str(tmp_path / "none.json")) == []


def test_search(spark, tmp_path):
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib" / "sig.py").write_text(LIBRARY)
    (tmp_path / "lib" / "bad.py").write_text("def (")
    (tmp_path / "lib" / "test_x.py").write_text("def f():\n    '''Doc.'''\n")
    roots = [str(tmp_path / "lib")]
    found = index.discover(spark, [*roots, str(tmp_path / "none")])
    assert found["chunk_counts"] == {"function": 3, "method": 1, "block": 1}
    assert found["errors"][0]["code"] == "missing_library_root"
    by = {r["name"]: r for r in found["functions"]}
    assert by["band_limited"]["calls"] == ["signal.butter", "signal.sosfilt"]
    assert by["band_limited"]["starred"]
    assert not by["load"]["has_data_input"]
    hits = index.similar(spark, roots, "bandpass eeg filter")
    assert hits["hits"][0]["name"] == "band_limited"
    assert hits["candidates_examined"] < hits["corpus_size"]
    line = by["band_limited"]["lineno"]
    spanned = index.similar(spark, roots, span=f"sig.py:{line}-{by['band_limited']['end_lineno']}")
    assert "band_limited" not in [h["name"] for h in spanned["hits"]]
    assert index.similar(spark, roots, "words", simple=True)["hits"][0]["name"] == "count_words"
    assert index.parse_span("a.py:9-3") is None


def test_relative_imports_hand_on_calls(spark, tmp_path):
    lib = tmp_path / "pkg"
    lib.mkdir()
    (lib / "util.py").write_text("import numpy as np\n\n\ndef smooth(x: list):\n    'Smooth.'\n    return np.convolve(x, x)\n")
    (lib / "use.py").write_text("from .util import smooth as s\n\n\ndef clean(data: list):\n    'Clean a signal.'\n    return abs(s(data))\n")
    got = {r.name: r.calls for r in scan.scan_tree(spark, str(tmp_path)).collect()}
    assert got["clean"] == ["abs", "np.convolve"]


def test_blocks_run_only_if_allowed(spark, tmp_path):
    _, g = pipeline(tmp_path, "data_loader", "custom_code", n0={"file_path": str(tmp_path / "t.csv")}, n1={"source": "import math\nout = frame.where('a > 1')\n"})
    (tmp_path / "t.csv").write_text("a,b\n1,2\n3,4\n")
    assert compile_graph(g, Context(spark, allow_code=True)).result("n1").count() == 1
    with pytest.raises(CompileError):
        compile_graph(g, Context(spark))


def test_rank_parts():
    assert rank.alignment(["a.f", "b.g"], ["a.f", "b.g"]) == 1.0
    assert rank.alignment(["signal.butter"], ["bandpass_filter"]) == 0.75
    assert rank.minhash([]) == [0] * 64
    assert rank.expand("ISI violation") == ["isi_violations", "quality_metrics"]
    assert scan.tags_of("bandpass_filter of eeg") == ["filter", "bandpass", "eeg"]


def test_stream_counts(spark, data, tmp_path):
    src = tmp_path / "in"
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(1).write.parquet(str(src))
    stream = spark.readStream.schema(events.schema).parquet(str(src))
    q = event_counts(stream, 3600.0, 1.0).writeStream.outputMode("append").format("memory").queryName("bins").start()
    q.processAllAvailable()
    q.stop()
    last = events.agg(F.max(F.window("ts", "3600 seconds").start)).first()[0]
    assert spark.table("bins").agg(F.sum("count")).first()[0] == events.where(F.window("ts", "3600 seconds").start < F.lit(last)).count()
