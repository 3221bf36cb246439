"""The discovered model of a process: tables, and their JSON form for a simulator."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame

from ..functions.scalars import WEEKDAYS
from ..sources.bpmn import activity_ids, to_bpmn


@dataclass(frozen=True)
class ProcessModel:
    """Tables; all have the size of a process, not of its log. DataFrames are immutable, so copies are free."""

    nodes: DataFrame
    flows: DataFrame
    gateways: DataFrame  # gateway, path, observed[, condition_id]
    arrivals: DataFrame  # bin, cases, share: observed; or family, mean, std: fitted
    calendars: DataFrame  # k, w, begin_min, end_min[, probability]
    performance: DataFrame  # a, family, mean, std
    resources: DataFrame  # r, a
    arrival_calendar: DataFrame | None = None  # w, begin_min, end_min
    batches: DataFrame | None = None  # task_id, json
    priorities: DataFrame | None = None  # priority_level, json
    branches: DataFrame | None = None  # id, json
    attributes: DataFrame | None = None  # attribute, share, is_case
    event_attributes: DataFrame | None = None  # attribute, a, share
    global_attributes: DataFrame | None = None  # attribute, share
    delays: DataFrame | None = None  # a, mean_s
    pools: DataFrame | None = None  # r, pool
    granule: int = 60
    fuzzy: bool = False

    def to_dict(self) -> dict:
        ids = {r["name"]: r["id"] for r in activity_ids(self.nodes).collect()}
        rows = lambda df: [] if df is None else [r.asDict() for r in df.collect()]
        texts = lambda df: sorted((json.loads(r["json"]) for r in rows(df)), key=str)
        clock = lambda m: f"{m // 60 % 24:02d}:{m % 60:02d}:00"
        calendars: dict = {}

        def period(r: dict) -> dict:
            day = WEEKDAYS[r["w"]].upper()
            out = {"from": day, "to": day, "beginTime": clock(r["begin_min"]), "endTime": clock(r["end_min"]) if r["end_min"] < 1440 else "23:59:59"}
            return out | ({"probability": r["probability"]} if "probability" in r else {})

        for r in rows(self.calendars):
            calendars.setdefault(str(r["k"]), []).append(period(r))
        # a resource is a profile of its own, or one of its pool's, whose tasks and calendar all share
        pool = {str(r["r"]): str(r["pool"]) for r in rows(self.pools)}
        profiles: dict = {}
        for r in rows(self.resources):
            members, tasks = profiles.setdefault(pool.get(str(r["r"]), str(r["r"])), (set(), set()))
            members.add(str(r["r"])), tasks.add(ids[r["a"]])
        paths: dict = {}
        for r in rows(self.gateways):
            paths.setdefault(r["gateway"], []).append({"path_id": r["path"], "value": r["observed"], **({"condition_id": r["condition_id"]} if r.get("condition_id") else {})})
        out = {
            "process_model": "process",
            "gateway_branching_probabilities": [{"gateway_id": k, "probabilities": v} for k, v in sorted(paths.items())],
            "arrival_time_distribution": [
                {"bin": r["bin"], "share": r["share"]} if "bin" in r else {"distribution_name": r["family"], "distribution_params": [{"value": r["mean"]}, {"value": r["std"]}]} for r in rows(self.arrivals)
            ],
            "arrival_time_calendar": [period(r) for r in rows(self.arrival_calendar)],
            "resource_profiles": [{"id": k, "resource_list": [{"id": m, "name": m, "amount": 1, "calendar": k, "assignedTasks": sorted(tasks)} for m in sorted(members)]} for k, (members, tasks) in sorted(profiles.items())],
            "resource_calendars": [{"id": k, "name": k, "time_periods": v} for k, v in sorted(calendars.items())],
            "task_resource_distribution": [{"task_id": ids[r["a"]], "distribution_name": r["family"], "distribution_params": [{"value": r["mean"]}, {"value": r["std"]}]} for r in rows(self.performance)],
            "event_distribution": [{"event_id": ids.get(r["a"], r["a"]), "mean": r["mean_s"]} for r in rows(self.delays)],
            "case_attributes": [r for r in rows(self.attributes) if r["is_case"]],
            "event_attributes": rows(self.event_attributes),
            "global_attributes": rows(self.global_attributes),
            "batch_processing": texts(self.batches),
            "branch_rules": texts(self.branches),
            "model_type": "FUZZY" if self.fuzzy else "CRISP",
            "granule_size": {"value": self.granule, "time_unit": "MINUTES"},
        }
        if out["case_attributes"]:
            out["prioritisation_rules"] = texts(self.priorities)
        return out

    def write(self, folder: str, name: str = "process") -> None:
        """<name>.bpmn and <name>.json below folder, which the driver owns."""
        path = Path(folder)
        path.mkdir(parents=True, exist_ok=True)
        (path / f"{name}.bpmn").write_text(to_bpmn(self.nodes, self.flows, name))
        (path / f"{name}.json").write_text(json.dumps(self.to_dict(), indent=1, default=str))
