"""Node kinds: their ports, parameters and metadata. One table; everything else reads it."""

from __future__ import annotations

import copy
import uuid
from dataclasses import dataclass, field

# Data tags of ports, node types, recording types.
TAGS = ("any", "series", "table", "text", "eeg", "spike", "lfp", "calcium")
NODE_TYPES = ("data_loader", "preprocessor", "analyzer", "visualizer", "model", "custom_code", "output")
SIGNALS = ("eeg", "spike", "lfp", "calcium")

# Which recordings a variant accepts from any of its ancestors.
ACCEPTED_SIGNALS = {
    "neural_filter": {"eeg", "lfp"}, "neural_montage": {"eeg", "lfp"}, "neural_ica": {"eeg"}, "neural_spectrum": {"eeg", "lfp"}, "neural_epochs": {"eeg"}, "neural_spike": {"spike"}, "neural_calcium": {"calcium"},
    "si_preprocess": {"spike"}, "si_sort": {"spike"}, "si_analyze": {"spike"}, "si_metrics": {"spike"}, "si_curate": {"spike"}, "si_export": {"spike"}, "si_compare": {"spike"},
}

#: the metadata key that names a node type's variant
VARIANT_KEY = {"data_loader": "signal_type", "preprocessor": "processor_type", "analyzer": "analyzer_type", "model": "provider"}


@dataclass(frozen=True)
class Port:
    name: str
    tag: str = "any"
    required: bool = True
    label: str = ""
    description: str = ""

    def accepts(self, other: Port) -> bool:
        return "any" in (self.tag, other.tag) or self.tag == other.tag

    def to_dict(self) -> dict:
        return {"name": self.name, "label": self.label or self.name, "data_kind": self.tag, "required": self.required, "description": self.description}


@dataclass(frozen=True)
class Ports:
    inputs: tuple[Port, ...] = ()
    outputs: tuple[Port, ...] = ()

    @staticmethod
    def _resolve(ports: tuple[Port, ...], name: str | None) -> tuple[str, Port | None]:
        """How a name (None: the only port) resolves: resolved, unknown, ambiguous or none_declared; and the port."""
        if name is not None:
            port = next((p for p in ports if p.name == name), None)
            return ("resolved" if port else "unknown" if ports else "none_declared"), port
        if len(ports) == 1:
            return "resolved", ports[0]
        return ("ambiguous" if ports else "none_declared"), None

    def input(self, name: str | None) -> tuple[str, Port | None]:
        return self._resolve(self.inputs, name)

    def output(self, name: str | None) -> tuple[str, Port | None]:
        return self._resolve(self.outputs, name)

    def to_dict(self) -> dict:
        return {"inputs": [p.to_dict() for p in self.inputs], "outputs": [p.to_dict() for p in self.outputs]}


@dataclass
class Param:
    """A parameter; a value of None means that its default holds."""

    name: str
    kind: str = "string"
    default: object = None
    options: list | None = None
    description: str = ""
    value: object = None

    def effective(self) -> object:
        return self.default if self.value is None else self.value

    def to_dict(self) -> dict:
        return {"name": self.name, "param_type": self.kind, "default_value": self.default, "value": self.value, "description": self.description, "options": self.options}


@dataclass
class Node:
    id: str
    node_type: str
    label: str = ""
    description: str = ""
    parameters: dict[str, Param] = field(default_factory=dict)
    position: tuple = (0, 0)
    metadata: dict = field(default_factory=dict)

    @property
    def ports(self) -> Ports:
        return ports_for(self.node_type, self.metadata)

    def param(self, name: str, default: object = None) -> object:
        p = self.parameters.get(name)
        value = p.effective() if p else None
        return default if value is None else value

    def to_dict(self) -> dict:
        return {"id": self.id, "node_type": self.node_type, "label": self.label, "description": self.description, "parameters": {k: p.to_dict() for k, p in self.parameters.items()}, "position": list(self.position), "metadata": self.metadata}

    @staticmethod
    def from_dict(d: dict) -> Node:
        known = ("name", "param_type", "default_value", "value", "description", "options")
        params = {}
        for key, p in (d.get("parameters") or {}).items():
            p = {k: p[k] for k in known if k in p} if isinstance(p, dict) else {"value": p}
            params[key] = Param(p.get("name", key), p.get("param_type", "string"), p.get("default_value"), p.get("options"), p.get("description", ""), p.get("value"))
        return Node(d["id"], d["node_type"], d.get("label", ""), d.get("description", ""), params, tuple(d.get("position") or (0, 0)), dict(d.get("metadata") or {}))


@dataclass(frozen=True)
class Kind:
    key: str
    node_type: str
    label: str
    variant: str | None
    ports: Ports
    params: tuple[Param, ...] = ()
    metadata: tuple = ()
    in_palette: bool = True
    description: str = ""

    def create(self, node_id: str | None = None, **values: object) -> Node:
        params = {p.name: copy.deepcopy(p) for p in self.params}
        for k, v in values.items():
            if k not in params:
                raise ValueError(f"{self.key} has no parameter {k!r}")
            params[k].value = v
        return Node(node_id or uuid.uuid4().hex, self.node_type, self.label, self.description, params, (0, 0), dict(self.metadata))


def _p(name: str, default: object, kind: str | None = None, options: list | None = None) -> Param:
    kind = kind or ("dropdown" if options else "number" if isinstance(default, (int, float)) else "string")
    return Param(name, kind, default, options)


def _io(inputs: str, outputs: str) -> Ports:
    """Ports from 'name:tag name:tag?' lists; a question mark makes an input optional."""
    make = lambda text: tuple(Port(n, t.rstrip("?"), not t.endswith("?")) for n, t in (x.split(":") for x in text.split()))
    return Ports(make(inputs), make(outputs))


_FILE = _p("file_path", "", "file")
_SI = "data:spike"


def _loader(signal: str, rate: float, formats: list[str], label: str, *more: Param) -> Kind:
    params = (_FILE, _p("file_format", "csv", None, formats), _p("sampling_rate", rate), _p("delimiter", ","), *more)
    return Kind(f"neural_loader_{signal}", "data_loader", label, signal, _io("", f"output:{signal}"), params, (("signal_type", signal),))


def _pre(key: str, label: str, variant: str, ports: Ports, *params: Param, **meta: object) -> Kind:
    return Kind(key, "preprocessor", label, variant, ports, params, (("processor_type", variant), *meta.items()))


def _ana(key: str, label: str, variant: str, ports: Ports, *params: Param, **meta: object) -> Kind:
    return Kind(key, "analyzer", label, variant, ports, params, (("analyzer_type", variant), *meta.items()))


def _si(key: str, label: str, stage: str, ports: Ports, *params: Param, kind: str = "analyzer") -> Kind:
    make = _ana if kind == "analyzer" else _pre
    return make(key, label, f"si_{stage}", ports, *params, si_stage=stage, signal_type="spike")


_TABLE = _io("data:table", "output:table")
_RATE = _p("sampling_rate", 250)
MODELS = {"claude": "Model (claude)", "gpt": "Model (gpt)"}

KINDS: dict[str, Kind] = {
    k.key: k
    for k in (
        Kind("data_loader", "data_loader", "Load CSV", None, _io("", "output:table"), (_FILE, _p("delimiter", ","))),
        _loader("eeg", 250, ["csv", "npy", "edf", "fif", "nwb"], "Load EEG"),
        _loader("lfp", 1000, ["csv", "npy"], "Load LFP"),
        _loader("spike", 1.0, ["csv", "npy"], "Load Spike", _p("time_column", "time"), _p("unit_column", "unit")),
        _loader("calcium", 30, ["csv", "npy"], "Load Calcium"),
        _pre("preprocessor_normalize", "Normalize", "normalize", _TABLE, _p("method", "minmax", None, ["minmax", "zscore", "robust"])),
        _pre("preprocessor_missing", "Handle Missing", "missing", _TABLE, _p("strategy", "mean", None, ["mean", "median", "drop", "forward_fill"])),
        _pre("preprocessor_split", "Train/Test Split", "split", _io("data:table", "X_train:table X_test:table y_train:series y_test:series"), _p("test_size", 0.2), _p("random_state", 42)),
        _pre("preprocessor_feature_select", "Feature Selection", "feature_select", _TABLE, _p("method", "kbest", None, ["kbest", "variance"]), _p("n_features", 10)),
        _pre("preprocessor_neural_filter", "Filter", "neural_filter", _io("data:any", "output:table"), _RATE, _p("low_hz", 1), _p("high_hz", 40), _p("notch_hz", 0)),
        _pre("preprocessor_neural_montage", "Montage", "neural_montage", _io("data:any", "output:table"), _RATE, _p("montage", "standard_1020")),
        _pre("preprocessor_neural_ica", "ICA", "neural_ica", _io("data:any", "output:table"), _RATE, _p("n_components", 0), _p("montage", "")),
        Kind("neural_si_recording", "data_loader", "Recording", "si_recording", _io("", "output:spike"), (_FILE, _p("format", "binary", None, ["binary", "spikeglx", "openephys", "intan", "blackrock", "neuralynx", "plexon", "nwb", "custom"]), _p("custom_format", ""), _p("sampling_rate", 30000), _p("num_channels", 0), _p("dtype", "int16")), (("signal_type", "spike"), ("si_stage", "recording"))),
        _si("preprocessor_neural_si", "Preprocess recording", "preprocess", _io(_SI, "output:spike"), _p("method", "bandpass_filter", None, ["bandpass_filter", "highpass_filter", "notch_filter", "common_reference", "whiten", "phase_shift", "blank_saturation", "correct_motion"]), _p("freq_min", 300), _p("freq_max", 6000), _p("notch_freq", 3000), _p("notch_q", 30), _p("reference", "global", None, ["global", "single", "local"]), kind="preprocessor"),
        _si("analyzer_neural_si_sort", "Sort spikes", "sort", _io(_SI, "output:spike"), _p("sorter_name", "simple", None, ["simple", "kilosort4", "mountainsort5", "spykingcircus2", "tridesclous2", "lupin"]), _p("folder", "si_sorter_output")),
        _si("analyzer_neural_si_analyze", "Sorting analyzer", "analyze", _io("recording:spike sorting:spike", "output:spike"), _p("extensions", "random_spikes,waveforms,templates,noise_levels")),
        _si("analyzer_neural_si_metrics", "Quality metrics", "metrics", _io(_SI, "analyzer:spike metrics:table"), _p("metric_names", "snr,isi_violation,presence_ratio,firing_rate,isolation_distance")),
        _si("analyzer_neural_si_curate", "Curate units", "curate", _io(_SI, "output:spike"), _p("snr_min", 5.0), _p("isi_violations_max", 0.2), _p("presence_ratio_min", 0.9), _p("firing_rate_min", 0.1), _p("isolation_distance_min", 0.0)),
        _si("analyzer_neural_si_export", "Export sorting", "export", _io(_SI, "output:text"), _p("method", "phy", None, ["phy", "nwb", "sortingview", "report"]), _p("output_path", "si_export")),
        _si("analyzer_neural_si_compare", "Compare sortings", "compare", _io("sorting1:spike sorting2:spike", "output:any"), _p("delta_time", 0.4), _p("match_score", 0.5)),
        _ana("analyzer_correlation", "Correlation", "correlation", _io("data:table", "result:table")),
        _ana("analyzer_clustering", "Clustering", "clustering", _io("data:table", "result:series"), _p("algorithm", "kmeans", None, ["kmeans", "dbscan", "hierarchical"]), _p("n_clusters", 3), _p("eps", 0.5), _p("min_samples", 5)),
        _ana("analyzer_regression", "Regression", "regression", _io("data:table", "result:any"), _p("model_type", "linear", None, ["linear", "polynomial", "ridge"])),
        _ana("analyzer_neural_spectrum", "Power Spectrum", "neural_spectrum", _io("data:any", "result:table"), _RATE, _p("nperseg", 256)),
        _ana("analyzer_neural_epochs", "Epochs / ERP", "neural_epochs", _io("data:any", "result:table"), _RATE, _p("tmin", -0.2), _p("tmax", 0.5), _p("event_id", 1), _p("event_column", ""), _p("montage", "")),
        _ana("analyzer_neural_spike", "Spike Analysis", "neural_spike", _io("data:any", "result:table"), _p("method", "psth", None, ["psth", "isi"]), _p("bin_size", 0.05), _p("t_start", 0), _p("t_end", 0), _p("n_bins", 50), _p("max_isi", 0)),
        _ana("analyzer_neural_calcium", "Calcium Analysis", "neural_calcium", _io("data:any", "result:table"), _p("method", "dff", None, ["dff", "events"]), _p("baseline_percentile", 10), _p("threshold", 3), _p("sampling_rate", 30)),
        Kind("visualizer", "visualizer", "Plot", None, _io("data:any", "")),
        *(Kind(f"model_{m}", "model", label, m, _io("data:any?", "response:text"), (_p("prompt", ""), _p("model", "default", None, ["default"])), (("provider", m),)) for m, label in MODELS.items()),
        Kind("custom_code", "custom_code", "Custom Code", None, _io("data:any", "output:any"), (_p("function_name", ""), _p("module", ""), _p("library_root", "", "file"))),
    )
}

_DEFAULT_PORTS = {
    "data_loader": _io("", "output:table"), "preprocessor": _TABLE, "analyzer": _io("data:table", "result:any"), "visualizer": _io("data:any", ""),
    "model": _io("data:any?", "response:text"), "custom_code": _io("data:any", "output:any"), "output": _io("data:any", ""),
}
_BY_STAGE = {dict(k.metadata)["si_stage"]: k for k in KINDS.values() if "si_stage" in dict(k.metadata)}
_BY_VARIANT = {(k.node_type, k.variant): k for k in KINDS.values() if k.variant}


def stage_of(metadata: dict) -> str | None:
    """A spike-sorting node's stage, whether spelled sort or si_sort."""
    stage = metadata.get("si_stage")
    return str(stage).removeprefix("si_") if stage else None


def variant_of(node_type: str, metadata: dict | None) -> str | None:
    metadata = metadata or {}
    if stage := stage_of(metadata):
        return f"si_{stage}"
    return metadata.get(VARIANT_KEY.get(node_type, ""))


def ports_for(node_type: str, metadata: dict | None = None) -> Ports:
    """Ports follow from the stage, else the variant, else the type; a source of custom code has no input."""
    if node_type not in NODE_TYPES:
        raise ValueError(f"unknown node type {node_type!r}")
    metadata = metadata or {}
    if kind := _BY_STAGE.get(stage_of(metadata)):
        return kind.ports
    if kind := _BY_VARIANT.get((node_type, metadata.get(VARIANT_KEY.get(node_type, "")))):
        return kind.ports
    if node_type == "custom_code" and metadata.get("has_data_input") is False:
        return Ports((), _DEFAULT_PORTS[node_type].outputs)
    return _DEFAULT_PORTS[node_type]


def kind_of(node: Node) -> Kind | None:
    """The kind whose fixed metadata a node matches most closely."""
    fits = [k for k in KINDS.values() if k.node_type == node.node_type and all(node.metadata.get(a) == b for a, b in k.metadata)]
    return max(fits, key=lambda k: len(k.metadata), default=None)


def describe() -> list[dict]:
    """Every kind as built by its factory."""
    out = []
    for k in KINDS.values():
        n = k.create("described")
        out.append({"kind": k.key, "palette_label": k.label, "in_palette": k.in_palette, "node_type": n.node_type, "label": n.label, "description": n.description, "metadata": n.metadata, "parameters": [p.to_dict() for p in n.parameters.values()], "ports": n.ports.to_dict()})
    return out
