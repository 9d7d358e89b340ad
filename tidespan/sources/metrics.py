"""The driver host's own metrics as points, for demonstrations and self-monitoring."""

from __future__ import annotations

import os
import shutil
import time

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "measurement string, tags map<string,string>, fields map<string,double>, timestamp long"


def _table(path: str) -> list[list[str]]:
    """The words of each line of a system file; none where there is no such file."""
    if not os.path.exists(path):
        return []
    with open(path) as f:
        return [line.replace(":", " ").split() for line in f]


def system_points(spark: SparkSession, disk: str = "/") -> DataFrame:
    """One point each of sys_cpu, sys_memory, sys_disk and sys_network, tagged with the host ``local``."""
    memory = {w[0]: float(w[1]) * 1024 for w in _table("/proc/meminfo") if len(w) > 1}
    net = [w for w in _table("/proc/net/dev") if len(w) > 9 and w[1].isdigit()]
    space = shutil.disk_usage(disk)
    total = memory.get("MemTotal", 0.0)
    found = {
        "sys_cpu": {"load_avg_1m": os.getloadavg()[0], "cores": float(os.cpu_count() or 1)},
        "sys_memory": {"total_bytes": total, "used_bytes": total - memory.get("MemAvailable", total)},
        "sys_disk": {"total_bytes": float(space.total), "used_bytes": float(space.used)},
        "sys_network": {"rx_bytes": float(sum(int(w[1]) for w in net)), "tx_bytes": float(sum(int(w[9]) for w in net))},
    }
    now = time.time_ns() // 1000
    return spark.createDataFrame([(name, {"host": "local"}, fields, now) for name, fields in found.items()], SCHEMA)
