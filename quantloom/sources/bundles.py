"""Result bundles: tables as Parquet, facts as JSON text, and a marker that says the bundle is whole."""

from __future__ import annotations

import hashlib
import json
import math
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKER = "_COMPLETE"
NEEDED = {"single": ("history", "metrics", "manifest"), "portfolio": ("history", "exposure", "metrics", "manifest")}


def strict(x: Any) -> Any:
    """x with NaN and infinities as null and times as text, so that any JSON reader takes it."""
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    if isinstance(x, dict):
        return {str(k): strict(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [strict(v) for v in x]
    return x.isoformat() if hasattr(x, "isoformat") else x


def dumps(x: Any) -> str:
    return json.dumps(strict(x), indent=2, sort_keys=True)


class Store:
    """Small files through Hadoop's file systems, so that they live where the tables do."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        p, fs = self._at(name)
        return fs.exists(p)

    def put(self, name: str, text: str) -> None:
        p, fs = self._at(name)
        out = fs.create(p, True)
        try:
            out.write(text.encode())
        finally:
            out.close()

    def get(self, name: str) -> str:
        rows = self.spark.read.text(f"{self.path}/{name}", wholetext=True).collect()
        return rows[0][0] if rows else ""

    def names(self) -> list[str]:
        p, fs = self._at("")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def identity(kind: str, path: str, **facts: Any) -> dict[str, Any]:
    now = datetime.now(timezone.utc).isoformat()
    return {"run_type": kind, "artifact_id": hashlib.sha256(f"{kind}|{path}|{now}".encode()).hexdigest()[:16], "created_at": now, **facts}


def save(spark: SparkSession, path: str, kind: str, tables: dict[str, DataFrame], metrics: dict[str, Any], manifest: dict[str, Any] | None = None, report: str = "") -> dict[str, Any]:
    """Writes a bundle; the marker comes last, so a broken write never looks whole."""
    facts = identity(kind, path, **(manifest or {})) | {"tables": sorted(tables)}
    store = Store(spark, path)
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{store.path}/{name}")
    store.put("metrics.json", dumps(metrics))
    store.put("manifest.json", dumps(facts))
    store.put("report.txt", report)
    store.put(MARKER, facts["artifact_id"])
    return facts


def inspect(spark: SparkSession, path: str) -> tuple[str, list[str]]:
    """missing, incomplete or valid, and what is absent."""
    store = Store(spark, path)
    names = store.names()
    if not names:
        return "missing", []
    kind = json.loads(store.get("manifest.json")).get("run_type", "single") if "manifest.json" in names else "single"
    want = [n if n not in ("metrics", "manifest") else f"{n}.json" for n in NEEDED.get(kind, NEEDED["single"])] + [MARKER]
    absent = [n for n in want if n not in names]
    return ("incomplete" if absent else "valid"), absent


def load(spark: SparkSession, path: str) -> dict[str, Any]:
    """Tables by name with metrics, manifest and report; raises unless the bundle is valid."""
    state, absent = inspect(spark, path)
    if state != "valid":
        raise FileNotFoundError(f"bundle at {path} is {state}: {', '.join(absent)}")
    store = Store(spark, path)
    manifest = json.loads(store.get("manifest.json"))
    out: dict[str, Any] = {n: spark.read.parquet(f"{store.path}/{n}") for n in manifest["tables"]}
    return out | {"manifest": manifest, "metrics": json.loads(store.get("metrics.json")), "report": store.get("report.txt")}


def rerunnable(manifest: dict[str, Any]) -> tuple[bool, list[str]]:
    """Whether a scenario can be derived: a portfolio run that names its slots, weights and settings."""
    absent = [k for k in ("slots", "slot_weights", "config") if not manifest.get(k)]
    return manifest.get("run_type") == "portfolio" and not absent, absent


def manifests(spark: SparkSession, pattern: str) -> DataFrame:
    """Manifests below a path pattern, newest first."""
    raw = spark.read.text(pattern, wholetext=True).select(F.col("value"), F.col("_metadata.file_path").alias("path"))
    facts = F.from_json("value", "run_type string, artifact_id string, created_at string, scenario_id string, baseline_run_id string, scenario_type string")
    return raw.select("path", facts.alias("f")).select("path", "f.*").orderBy(F.desc("created_at"), "artifact_id")


def scenario(base: dict[str, Any], volatility: float = 1.0, slippage: float = 1.0, commission: float = 1.0) -> dict[str, Any]:
    """A stress run's settings: the sizing target and the cost rates scaled."""
    if min(volatility, slippage, commission) <= 0:
        raise ValueError("multipliers must be positive")
    c = dict(base.get("config", {}))
    c["target_vol"] = c.get("target_vol", 0.10) * volatility
    c["spread_ticks"] = max(0, round(c.get("spread_ticks", 1) * slippage))
    c["commission_rate"] = c.get("commission_rate", 2.5) * commission
    return {"scenario_type": "stress_rerun", "baseline_run_id": base.get("artifact_id"), "config": c, "multipliers": {"volatility": volatility, "slippage": slippage, "commission": commission}}


STAGES = ("queued", "preparing", "loading", "simulating", "analysing", "writing", "done")


class Jobs:
    """Job records, one JSON file each, and their control by Spark job groups."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Store(spark, path)

    def put(self, job_id: str, status: str, stage: str = "queued", **facts: Any) -> dict[str, Any]:
        if stage not in STAGES or status not in ("queued", "running", "completed", "failed", "timeout", "cancelled"):
            raise ValueError(f"unknown status {status} or stage {stage}")
        old = self.get(job_id) or {"created_at": datetime.now(timezone.utc).isoformat()}
        row = old | facts | {"job_id": job_id, "status": status, "stage": stage, "stage_order": STAGES.index(stage) + 1, "stage_count": len(STAGES), "updated_at": datetime.now(timezone.utc).isoformat()}
        self.store.put(f"{job_id}.json", dumps(row))
        return row

    def get(self, job_id: str) -> dict[str, Any] | None:
        return json.loads(self.store.get(f"{job_id}.json")) if self.store.exists(f"{job_id}.json") else None

    def list(self, limit: int = 20) -> DataFrame:
        raw = self.spark.read.text(f"{self.store.path}/*.json", wholetext=True)
        facts = F.from_json("value", "job_id string, status string, stage string, created_at string, updated_at string")
        return raw.select(facts.alias("f")).select("f.*").orderBy(F.desc("created_at"), "job_id").limit(limit)

    def run(self, job_id: str, work) -> dict[str, Any]:
        """work() under a job group of this id, its end recorded."""
        self.spark.sparkContext.setJobGroup(job_id, job_id, interruptOnCancel=True)
        self.put(job_id, "running", "simulating")
        try:
            result = work()
        except Exception as e:
            return self.put(job_id, "failed", "simulating", error=str(e)[:2000])
        return self.put(job_id, "completed", "done", result=result if isinstance(result, (dict, str, type(None))) else str(result))

    def cancel(self, job_id: str) -> dict[str, Any]:
        self.spark.sparkContext.cancelJobGroup(job_id)
        return self.put(job_id, "cancelled", (self.get(job_id) or {}).get("stage", "queued"))
