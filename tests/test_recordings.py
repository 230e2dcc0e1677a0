"""EDF recordings and BIDS folders, written and read again."""

import json

import numpy as np
import pytest

from dagspark.operators.tabular import ROW
from dagspark.sources import bids, edf, tables


def signals(n=1000, seed=1):
    rng = np.random.default_rng(seed)
    return {"Fp1": rng.normal(size=n) * 50, "Cz": np.cumsum(rng.normal(size=n)), "flat": np.zeros(n)}


def columns(df, *names):
    rows = df.orderBy(ROW).collect()
    return [r[ROW] for r in rows], [np.array([r[n] for r in rows]) for n in names]


@pytest.mark.parametrize("records", [0, 1, 3])
def test_edf_reads_back_by_partitions(spark, tmp_path, records):
    x = signals()
    path = tmp_path / "a.edf"
    path.write_bytes(edf.edf_bytes(x, 100))
    df = edf.load_edf(spark, str(path), records=records)
    assert df.columns == [ROW, "Fp1", "Cz", "flat"]
    assert df.rdd.getNumPartitions() == (1 if not records else -(-10 // records))
    ids, got = columns(df, *x)
    assert ids == list(range(1000))
    for g, w in zip(got, x.values(), strict=True):
        assert g == pytest.approx(w * 1e-6, abs=(w.max() - w.min() + 1) * 1e-6 / 65535)
    one = edf.load_edf(spark, str(path), ["Cz"], records)
    assert one.columns == [ROW, "Cz"]
    assert np.array_equal(columns(one, "Cz")[1][0], got[1])
    assert tables.load_signal(spark, str(path), "eeg", "edf").count() == 1000


def test_slower_signals_hold_their_values_and_annotations_are_left_out():
    head = lambda *fields: b"".join(str(v).ljust(n).encode() for v, n in fields)
    start = head(("0", 8), ("", 80), ("", 80), ("", 8), ("", 8), (256 * 4, 8), ("EDF+C", 44), (-1, 8), (1, 8), (3, 4))
    three = lambda n, *v: b"".join(str(x).ljust(n).encode() for x in v)
    each = three(16, "x", "EDF Annotations", "X") + three(80, "", "", "") + three(8, "V", "", "mV") + three(8, 0, -1, -1) + three(8, 100, 1, 1) + three(8, 0, -32768, -1000) + three(8, 1000, 32767, 1000) + three(80, "", "", "") + three(8, 4, 2, 2) + three(32, "", "", "")
    data = np.array([[10, 20, 30, 40, 0, 0, 500, -500], [50, 60, 70, 80, 0, 0, 1000, 0]], "<i2").tobytes()
    import io

    h = edf.read_header(io.BytesIO(start + each + data))
    assert [(s.label, s.samples) for s in h.signals] == [("x", 4), ("X-2", 2)]
    assert (h.records, h.per_record, h.rate) == (2, 4, 4.0)
    assert edf.values(data, h, h.signals[0]).tolist() == [1, 2, 3, 4, 5, 6, 7, 8]
    assert edf.values(data, h, h.signals[1]) == pytest.approx(np.array([0.5, 0.5, -0.5, -0.5, 1, 1, 0, 0]) * 1e-3)


def test_24_bits():
    h = edf.Header(0, 1, 1.0, 3, 9, (edf.Signal("a", 0, 3, 1.0, 0.0),))
    data = b"".join(int(v & 0xFFFFFF).to_bytes(3, "little") for v in (-1, 8388607, -8388608))
    assert edf.values(data, h, h.signals[0]).tolist() == [-1, 8388607, -8388608]


def test_bad_files(spark, tmp_path):
    whole = edf.edf_bytes(signals(), 100)
    for name, data, said in (("short.edf", whole[: len(whole) - 10], "data records"), ("none.edf", b"text" * 100, "no EDF header"), ("head.edf", whole[:300], "cut short")):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception, match=said):
            edf.load_edf(spark, str(tmp_path / name)).count()
    (tmp_path / "fine.edf").write_bytes(whole)
    with pytest.raises(Exception, match="no channels Pz"):
        edf.load_edf(spark, str(tmp_path / "fine.edf"), ["Pz"]).count()


def test_bids_side_cars_are_inherited(spark, tmp_path):
    root = tmp_path / "study"
    first, second = root / "sub-01" / "eeg", root / "sub-02" / "eeg"
    for f in (first, second):
        f.mkdir(parents=True)
    (root / "dataset_description.json").write_text("{}")
    (root / "task-rest_eeg.json").write_text(json.dumps({"SamplingFrequency": 100, "PowerLineFrequency": 50, "Place": "lab"}))
    (root / "task-rest_channels.tsv").write_text("name\ttype\tstatus\nFp1\tEEG\tgood\nCz\tEEG\tbad\nflat\tMISC\tn/a\n")
    (root / "task-move_eeg.json").write_text(json.dumps({"PowerLineFrequency": 1}))
    (root / "sub-02" / "sub-02_task-rest_eeg.json").write_text(json.dumps({"PowerLineFrequency": 60}))
    (second / "sub-02_task-rest_channels.tsv").write_text("name\ttype\tstatus\nFp1\tEEG\tbad\n")
    for i, f in ((1, first), (2, second)):
        (f / f"sub-0{i}_task-rest_eeg.edf").write_bytes(edf.edf_bytes(signals(300, i), 100))
        (f / f"sub-0{i}_task-rest_events.tsv").write_text(f"onset\tduration\ttrial_type\n0.{i}\t1\tgo\n1.5\tn/a\tstop\n")
    assert tables.sniff(str(root)) == "bids"
    found = bids.load_bids(spark, str(root))
    rows = {r.entities["sub"]: r for r in found.recordings.collect()}
    assert rows["01"].metadata == {"SamplingFrequency": "100", "PowerLineFrequency": "50", "Place": "lab"}
    assert rows["02"].metadata == {"SamplingFrequency": "100", "PowerLineFrequency": "60", "Place": "lab"}
    assert rows["01"].entities == {"sub": "01", "task": "rest"}
    status = {(r.recording[-20:-18], r.name): r.status for r in found.channels().collect()}
    assert {k: v for k, v in status.items() if k[1] != "flat"} == {("01", "Fp1"): "good", ("01", "Cz"): "bad", ("02", "Fp1"): "bad"}
    assert sorted((r.onset, r.duration, r.trial_type) for r in found.events().where("trial_type = 'go'").collect()) == [(0.1, 1.0, "go"), (0.2, 1.0, "go")]
    assert found.samples("sub-01_task-rest_eeg.edf", good_only=True).columns == [ROW, "Fp1", "flat"]
    assert found.samples("sub-02_task-rest_eeg.edf").count() == 300
    with pytest.raises(bids.BidsError, match="2 recordings"):
        tables.load_signal(spark, str(root), "eeg")
