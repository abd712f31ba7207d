"""Benchmark the headline queries; prints ONE JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEATS (timed runs after one warm-up, default 3), BENCH_QUERIES
(comma list, default the headline set), BENCH_EVENTLOG (default 1: shuffle
bytes per query from Spark's event log in a fresh scratch folder). Each run
writes to the ``noop`` sink.
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["top_keywords", "tfidf_weights", "vocabulary", "ngrams", "epsilon_pairs_sparse",
            "dbscan_sparse", "connected_components", "ward_threshold", "compare_clusterings",
            "stratified_split", "vote_plurality"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]

    from bugsift import session as S
    from bugsift.session import local_session
    from bugsift.plans.catalog import QUERIES

    # Spark's event log, in a fresh scratch folder, gives shuffle bytes per query
    events = os.environ.get("BENCH_EVENTLOG", "1") != "0"
    log_dir = tempfile.mkdtemp(prefix="bugsift-bench-events-", dir="/tmp") if events else None
    extra = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
             "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false"} if events else {}
    spark = local_session(cpus, app="bugsift-bench", extra=extra)
    sc = spark.sparkContext
    times, rows, rounds = {}, {}, {}
    for name in names:
        runs = []
        for k in range(repeats + 1):
            sc.setJobGroup(f"{name}#{k}", name)
            S.LOOP_ROUNDS.clear()
            t0 = time.perf_counter()
            df = QUERIES[name](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            spark.catalog.clearCache()
            if k > 0 or repeats == 0:
                runs.append(dt)
        times[name] = round(statistics.median(runs), 3)
        if S.LOOP_ROUNDS:
            rounds[name] = dict(S.LOOP_ROUNDS)
        sc.setJobGroup(f"{name}#rows", name)
        rows[name] = QUERIES[name](spark, sf_dir).count()
        spark.catalog.clearCache()
        print(f"# {name}: {times[name]}s rows={rows[name]}", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    spark.stop()
    shuffle = shuffle_bytes(log_dir, repeats) if events else {}
    print(json.dumps({"metric": "headline_total_median", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "rows": rows, "shuffle_bytes": shuffle, "loop_rounds": rounds, "sf": sf,
                      "cpus": cpus, "repeats": repeats}))


def shuffle_bytes(log_dir: str, repeats: int) -> dict:
    """Shuffle bytes written by the last timed run of each query (from the event log)."""
    stage_group, written = {}, {}
    for path in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True):
        if os.path.isdir(path) or os.path.basename(path).startswith(".") or path.endswith(".crc"):
            continue
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    group = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    for sid in ev.get("Stage IDs", []):
                        stage_group[sid] = group
                elif kind == "SparkListenerStageCompleted":
                    info = ev["Stage Info"]
                    for acc in info.get("Accumulables", []):
                        if acc.get("Name") == "internal.metrics.shuffle.write.bytesWritten":
                            written[info["Stage ID"]] = written.get(info["Stage ID"], 0) + int(acc.get("Value", 0))
    out = {}
    for sid, b in written.items():
        g = stage_group.get(sid) or ""
        name, _, run = g.rpartition("#")
        if run == str(repeats):
            out[name] = out.get(name, 0) + b
    return out


if __name__ == "__main__":
    main()
