"""Stored backtest runs: immutable folders with Parquet tables and JSON, complete once the marker is there."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os
import shutil

from pyspark.sql import DataFrame, SparkSession


def canonical(value):
    """JSON-ready with whole numbers as floats and keys sorted, so that equal settings hash alike."""
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, (int, float)):
        return float(value)
    if isinstance(value, dict):
        return {str(k): canonical(value[k]) for k in sorted(value, key=str)}
    if isinstance(value, (list, tuple)):
        return [canonical(v) for v in value]
    return str(value)


def config_id(settings: dict, keys: list[str] | None = None) -> str:
    picked = settings if keys is None else {k: settings[k] for k in keys if k in settings}
    return hashlib.sha1(json.dumps(canonical(picked), sort_keys=True).encode()).hexdigest()[:10]


def save_run(root: str, name: str, meta: dict, tables: dict[str, DataFrame], now: dt.datetime | None = None) -> str:
    """Write tables and meta, the marker last; a taken id gets a number."""
    stamp = (now or dt.datetime.now(dt.UTC)).strftime("%Y%m%dT%H%M%S")
    base = run = f"{stamp}_{name}"
    n = 1
    while os.path.exists(f"{root}/{run}"):
        run, n = f"{base}_{n}", n + 1
    os.makedirs(f"{root}/{run}")
    for table, df in tables.items():
        df.write.parquet(f"{root}/{run}/{table}")
    with open(f"{root}/{run}/meta.json", "w") as f:
        json.dump(meta | {"run": run, "config_id": config_id(meta.get("settings", {}))}, f, default=str)
    open(f"{root}/{run}/_SUCCESS", "w").close()
    return run


def list_runs(root: str, latest: bool = False) -> list[dict]:
    """Meta of complete runs, newest first; ``latest``: one for each configuration."""
    out = []
    for run in sorted(os.listdir(root), reverse=True) if os.path.isdir(root) else []:
        if os.path.exists(f"{root}/{run}/_SUCCESS"):
            with open(f"{root}/{run}/meta.json") as f:
                out.append(json.load(f))
    if latest:
        seen: set[str] = set()
        out = [m for m in out if not (m["config_id"] in seen or seen.add(m["config_id"]))]
    return out


def load_run(spark: SparkSession, root: str, run: str, table: str) -> DataFrame:
    if not os.path.exists(f"{root}/{run}/_SUCCESS"):
        raise FileNotFoundError(f"{run} isn't complete")
    return spark.read.parquet(f"{root}/{run}/{table}")


def prune_runs(root: str, keep: int) -> list[str]:
    """Delete all but the newest ``keep`` runs of each configuration."""
    counts: dict[str, int] = {}
    gone = []
    for m in list_runs(root):
        counts[m["config_id"]] = counts.get(m["config_id"], 0) + 1
        if counts[m["config_id"]] > keep:
            shutil.rmtree(f"{root}/{m['run']}")
            gone.append(m["run"])
    return gone


def write_status(path: str, status: dict, now: dt.datetime | None = None) -> None:
    """Replace a status file in one step."""
    with open(f"{path}.tmp", "w") as f:
        json.dump(status | {"finished_at": (now or dt.datetime.now(dt.UTC)).isoformat()}, f, default=str)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f"{path}.tmp", path)


def read_status(path: str) -> dict | None:
    if not os.path.exists(path):
        return None
    with open(path) as f:
        return json.load(f)
