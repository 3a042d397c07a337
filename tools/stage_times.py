"""Summarise a Spark event log: per-stage wall time, tasks and shuffle bytes.

Usage: python tools/stage_times.py <event-log-file-or-folder> [top_n]

Write the log with BENCH_EVENT_LOG=<scratch folder> python bench.py ...
(the Spark UI stays off; the log is plain JSON lines).
"""

from __future__ import annotations

import json
import os
import sys


def _files(path: str) -> list[str]:
    """Event log files under ``path`` (Spark 4 writes rolling logs as a
    folder of ``events_*`` files)."""
    if not os.path.isdir(path):
        return [path]
    out = []
    for root, _dirs, names in os.walk(path):
        out += [os.path.join(root, n) for n in names if not n.startswith(".") and not n.startswith("appstatus")]
    return sorted(out)


def _lines(path: str):
    if path.endswith(".zstd"):
        import io

        import zstandard

        with open(path, "rb") as raw:
            yield from io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(raw), encoding="utf-8")
        return
    with open(path, encoding="utf-8") as fh:
        yield from fh


def summarise(path: str, top: int = 15) -> list[dict]:
    stages: dict[tuple[int, int], dict] = {}
    for f in _files(path):
        for line in _lines(f):
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerStageCompleted":
                    info = ev["Stage Info"]
                    key = (info["Stage ID"], info["Stage Attempt ID"])
                    acc = {a.get("Name"): a.get("Value") for a in info.get("Accumulables", [])}
                    stages[key] = {
                        "stage": info["Stage ID"],
                        "name": info["Stage Name"][:60],
                        "tasks": info["Number of Tasks"],
                        "sec": round((info.get("Completion Time", 0) - info.get("Submission Time", 0)) / 1000, 3),
                        "shuffle_write_mb": round(int(acc.get("internal.metrics.shuffle.write.bytesWritten", 0) or 0) / 2**20, 2),
                        "shuffle_read_mb": round(
                            (int(acc.get("internal.metrics.shuffle.read.remoteBytesRead", 0) or 0)
                             + int(acc.get("internal.metrics.shuffle.read.localBytesRead", 0) or 0)) / 2**20, 2),
                    }
    return sorted(stages.values(), key=lambda s: -s["sec"])[:top]


if __name__ == "__main__":
    for row in summarise(sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 15):
        print(json.dumps(row))
