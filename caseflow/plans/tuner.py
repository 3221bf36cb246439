"""Hyper-parameter search: a tree-structured Parzen estimator over small spaces, and tables of trials."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRIAL_SCHEMA = "trial int, status string, loss double, params map<string,string>"


@dataclass
class Tuner:
    """space: name -> (low, high) of a number, or a list of choices."""

    space: dict
    warm_up: int = 20
    gamma: float = 0.25
    candidates: int = 24
    seed: int = 3
    trials: list[dict] = field(default_factory=list)

    def ask(self) -> dict:
        rng = np.random.Generator(np.random.PCG64(self.seed + len(self.trials)))
        done = [t for t in self.trials if t["status"] == "ok"]
        if len(done) < self.warm_up:
            return {k: self._random(v, rng) for k, v in self.space.items()}
        done.sort(key=lambda t: t["loss"])
        n = max(1, int(np.ceil(self.gamma * len(done))))
        return {k: self._better(k, v, done[:n], done[n:], rng) for k, v in self.space.items()}

    @staticmethod
    def _random(v, rng):
        return v[int(rng.integers(len(v)))] if isinstance(v, list) else float(rng.uniform(*v))

    def _better(self, k, v, good, bad, rng):
        if isinstance(v, list):
            share = lambda ts: np.array([1 + sum(t["params"][k] == c for t in ts) for c in v], float)
            g, b = share(good), share(bad)
            ratio = (g / g.sum()) / (b / b.sum())
            drawn = rng.choice(len(v), size=self.candidates, p=g / g.sum())
            return v[int(drawn[np.argmax(ratio[drawn])])]
        width = (v[1] - v[0]) / max(2.0, np.sqrt(len(good)) * 2)
        at = lambda ts: np.array([t["params"][k] for t in ts] or [(v[0] + v[1]) / 2])
        x = np.clip(rng.choice(at(good), self.candidates) + rng.normal(0, width, self.candidates), *v)
        density = lambda p: np.exp(-(((x[:, None] - p[None]) / width) ** 2) / 2).mean(axis=1) + 1e-12
        return float(x[np.argmax(density(at(good)) / density(at(bad)))])

    def tell(self, params: dict, loss: float | None):
        """A missing or negative loss is a failed trial; it counts as 1 and is never the best."""
        ok = loss is not None and loss >= 0
        self.trials.append({"params": params, "status": "ok" if ok else "fail", "loss": float(loss) if ok else 1.0})

    def run(self, objective: Callable[[dict], float], iterations: int) -> dict:
        for _ in range(iterations):
            params = self.ask()
            try:
                loss = objective(params)
            except Exception:  # any failing step fails its trial, not the search
                loss = None
            self.tell(params, loss)
        return self.best()

    def best(self) -> dict:
        ok = [t for t in self.trials if t["status"] == "ok"]
        if not ok:
            raise ValueError("no trial succeeded")
        return min(ok, key=lambda t: t["loss"])

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(k, t["status"], t["loss"], {a: str(b) for a, b in t["params"].items()}) for k, t in enumerate(self.trials)]
        return spark.createDataFrame(rows, TRIAL_SCHEMA)


def best_trial(trials: DataFrame) -> DataFrame:
    """The successful trial (trial, status, loss, ...) with the smallest loss, the first of equals."""
    return trials.filter("status = 'ok'").orderBy("loss", "trial").limit(1)


def response(measurements: DataFrame) -> DataFrame:
    """(trial, loss, status) of (trial, distance): mean distance; none or negative fails, with loss 1."""
    mean = measurements.groupBy("trial").agg(F.avg("distance").alias("mean"))
    ok = F.col("mean").isNotNull() & (F.col("mean") >= 0)
    return mean.select("trial", F.when(ok, F.round("mean", 7)).otherwise(F.lit(1.0)).alias("loss"), F.when(ok, "ok").otherwise("fail").alias("status"))
