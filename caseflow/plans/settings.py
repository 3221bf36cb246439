"""Settings of a discovery run: typed sections with defaults, YAML in and out, older versions read, unknown keys reported."""

from __future__ import annotations

import warnings
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from pathlib import Path

import yaml

#: Names of metrics and the spellings that configurations use.
METRICS = {
    "control_flow_log_distance": ("cfld", "dl", "control flow log distance"),
    "2_gram": ("two_gram_distance", "2_gram_distance", "2-gram"),
    "3_gram": ("n_gram", "n_gram_distance", "three_gram_distance", "3_gram_distance", "3-gram"),
    "circadian_event_distribution": ("circadian_emd", "circadian"),
    "circadian_workforce_distribution": ("workforce_emd", "workforce_distribution", "workforce"),
    "case_arrival_distribution": ("arrival_event_distribution", "arrival_emd", "arrival"),
    "relative_event_distribution": ("relative_emd", "relative"),
    "absolute_event_distribution": ("absolute_hourly_emd", "absolute_hour_emd", "abs_hourly_emd", "abs_hour_emd", "absolute_emd", "absolute"),
    "cycle_time_distribution": ("cycle_time_emd", "cycle_time"),
}
DELAY_METRICS = ("absolute_event_distribution", "cycle_time_distribution", "circadian_event_distribution", "relative_event_distribution")
CALENDARS = ("undifferentiated", "resource", "pool", "resource_fuzzy")


def metric(name: str) -> str:
    """A metric's own name from any of its spellings, in any case."""
    low = name.strip().lower()
    for k, more in METRICS.items():
        if low == k or low in more:
            return k
    raise ValueError(f"unknown metric {name!r}")


@dataclass
class Common:
    train_log_path: str = ""
    test_log_path: str | None = None
    process_model_path: str | None = None
    log_ids: dict = field(default_factory=dict)
    perform_final_evaluation: bool = False
    num_final_evaluations: int = 10
    evaluation_metrics: list = field(default_factory=list)
    use_observed_arrival_distribution: bool = False
    clean_intermediate_files: bool = True
    discover_data_attributes: bool = False

    def __post_init__(self):
        self.perform_final_evaluation |= self.test_log_path is not None
        if not self.perform_final_evaluation:
            self.num_final_evaluations = 0
        else:
            self.num_final_evaluations = self.num_final_evaluations or 10
            self.evaluation_metrics = [metric(m) for m in self.evaluation_metrics] or list(METRICS)


@dataclass
class Preprocessing:
    multitasking: bool = False
    enable_time_concurrency_threshold: float = 0.5
    df: float = 0.75
    l2l: float = 0.9
    l1l: float = 0.9


@dataclass
class ControlFlow:
    optimization_metric: str = "3_gram"
    num_iterations: int = 10
    num_evaluations_per_iteration: int = 3
    gateway_probabilities: str = "discovery"
    mining_algorithm: str | None = "sm1"
    epsilon: tuple | float | None = (0.0, 1.0)
    eta: tuple | float | None = (0.0, 1.0)
    discover_branch_rules: bool = False
    f_score: float = 0.7
    replace_or_joins: bool | None = False
    prioritize_parallelism: bool | None = False

    def __post_init__(self):
        self.optimization_metric = metric(self.optimization_metric)


@dataclass
class ResourceModel:
    optimization_metric: str = "circadian_event_distribution"
    num_iterations: int = 10
    num_evaluations_per_iteration: int = 3
    discovery_type: str = "undifferentiated"
    granularity: tuple | int = (15, 60)
    confidence: tuple | float = (0.5, 0.85)
    support: tuple | float = (0.01, 0.3)
    participation: tuple | float = 0.4
    fuzzy_angle: tuple | float = (0.1, 0.9)
    discover_prioritization_rules: bool = False
    discover_batching_rules: bool = False

    def __post_init__(self):
        self.optimization_metric = metric(self.optimization_metric)
        if self.discovery_type not in CALENDARS:
            raise ValueError(f"unknown calendar type {self.discovery_type!r}")


@dataclass
class Delays:
    optimization_metric: str = "relative_event_distribution"
    discovery_method: str = "eclipse_aware"
    num_iterations: int = 1
    num_evaluations_per_iteration: int = 3

    def __post_init__(self):
        self.optimization_metric = metric(self.optimization_metric)
        if self.optimization_metric not in DELAY_METRICS:
            raise ValueError(f"delays are not measured by {self.optimization_metric}")


SECTIONS = {"common": Common, "preprocessing": Preprocessing, "control_flow": ControlFlow, "resource_model": ResourceModel, "extraneous_activity_delays": Delays}


@dataclass
class Settings:
    common: Common = field(default_factory=Common)
    preprocessing: Preprocessing = field(default_factory=Preprocessing)
    control_flow: ControlFlow = field(default_factory=ControlFlow)
    resource_model: ResourceModel = field(default_factory=ResourceModel)
    extraneous_activity_delays: Delays | None = None
    version: int = 5

    def __post_init__(self):
        if self.common.process_model_path:
            c = self.control_flow
            c.mining_algorithm = c.epsilon = c.eta = c.replace_or_joins = c.prioritize_parallelism = None

    @staticmethod
    def one_shot(log_path: str = "") -> Settings:
        """A run without search: one iteration at fixed parameters."""
        flow = ControlFlow(num_iterations=1, num_evaluations_per_iteration=1, epsilon=0.3, eta=0.5)
        work = ResourceModel(num_iterations=1, num_evaluations_per_iteration=1, discovery_type="resource", granularity=30, confidence=0.6, support=0.2, participation=0.4)
        return Settings(Common(train_log_path=log_path), Preprocessing(), flow, work, Delays())

    @staticmethod
    def from_dict(data: dict) -> Settings:
        data = migrated(data)
        parts = {}
        for name, kind in SECTIONS.items():
            given = data.get(name)
            if given is None:
                continue
            given, known = dict(given), {f.name for f in fields(kind)}
            for k in list(given):
                if k not in known:
                    warnings.warn(f"{name}: unknown key {k}", stacklevel=2)
                    del given[k]
                elif isinstance(given[k], list) and k not in ("evaluation_metrics",):
                    given[k] = tuple(given[k])
            parts[name] = kind(**given)
        return Settings(**parts, version=5)

    @staticmethod
    def from_yaml(path: str) -> Settings:
        return Settings.from_dict(yaml.safe_load(Path(path).read_text()))

    def to_dict(self) -> dict:
        plain = lambda v: list(v) if isinstance(v, tuple) else v
        out = {k: {a: plain(b) for a, b in asdict(v).items()} for k, v in vars(self).items() if is_dataclass(v)}
        return out | {"version": self.version}

    def to_yaml(self, path: str) -> None:
        Path(path).write_text(yaml.safe_dump(self.to_dict(), sort_keys=False))


#: Settings that are read and kept but steer nothing here.
WITHOUT_EFFECT = {"resource_model": ("optimization_metric", "num_evaluations_per_iteration"), "extraneous_activity_delays": ("optimization_metric", "num_iterations", "num_evaluations_per_iteration")}


def without_effect(settings: Settings) -> list[str]:
    """The settings that differ from their defaults and have no effect."""
    parts = {name: (getattr(settings, name), SECTIONS[name]()) for name in WITHOUT_EFFECT}
    return [f"{name}.{k}" for name, (own, plain) in parts.items() if own is not None for k in WITHOUT_EFFECT[name] if getattr(own, k) != getattr(plain, k)]


def migrated(data: dict) -> dict:
    """Settings of versions 2 and 4 in the layout of version 5."""
    data = {k: dict(v) if isinstance(v, dict) else v for k, v in data.items()}
    common = data.setdefault("common", {})
    if "log_path" in common:
        common["train_log_path"] = common.pop("log_path")
    if "repetitions" in common:
        common["num_final_evaluations"] = common.pop("repetitions")
    if "discover_case_attributes" in common:
        common["discover_data_attributes"] = common.pop("discover_case_attributes")
    if "structure" in data:
        data["control_flow"] = data.pop("structure")
    if "calendars" in data:
        old = data.pop("calendars")
        data["resource_model"] = old.get("resource_profiles", old)
        if "case_arrival" in old:
            data["resource_model"].pop("case_arrival", None)
    for name in ("control_flow", "resource_model"):
        part = data.get(name) or {}
        if "max_evaluations" in part:
            part["num_iterations"] = part.pop("max_evaluations")
        for old, new in (("or_rep", "replace_or_joins"), ("and_prior", "prioritize_parallelism")):
            if old in part:
                v = part.pop(old)
                part[new] = bool(v[0] if isinstance(v, list) else v)
        if isinstance(part.get("resource_profiles"), dict):
            part |= part.pop("resource_profiles")
    return data


def schema() -> dict:
    """Names, types and defaults of all sections."""
    return {k: {f.name: {"type": str(f.type), "default": getattr(kind(), f.name)} for f in fields(kind)} for k, kind in SECTIONS.items()}
