"""Wall time of the headline operators on one machine; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and threads. Each
query runs its whole plan from the tables; nothing is kept from one query to the next.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from lakewitness.operators import diagnosis, diff, fingerprint, profile, resample, transforms  # noqa: E402
from lakewitness.plans.evidence import Evidence  # noqa: E402
from lakewitness.plans.workspace import Workspace  # noqa: E402
from lakewitness.session import build_session  # noqa: E402


def sink(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def evidence(ws: Workspace, *ids: int) -> Evidence:
    """Evidence of some versions only, started from scratch."""
    return Evidence(ws.spark, {i: ws.frames[i] for i in ids}, ws.registry.where(ws.registry["version_id"].isin(*ids)))


def profile_lines(ws):
    sink(evidence(ws, 4).columns)


def correlate_lines(ws):
    sink(profile.high_correlations({4: ws.frames[4]}))


def duplicate_lines(ws):
    sink(profile.duplicate_rows({5: ws.frames[5]}))


def keyed_rows_orders(ws):
    sink(diff.keyed_row_diff(2, ws.frames[1], ws.frames[2], ["order_id"]))


def multiset_rows_lines(ws):
    sink(diff.multiset_row_diff(5, ws.frames[4], ws.frames[5]))


def compare_orders(ws):
    sink(evidence(ws, 1, 2).diff.scores)


def diagnose_orders(ws):
    sink(evidence(ws, 1, 2).findings)


def content_hash_lines(ws):
    sink(fingerprint.content_hash(ws.frames[4]))


def target_associations_orders(ws):
    sink(diagnosis.target_associations(ws.frames[3], 3, "order_state"))


def median_imputation_lines(ws):
    sink(transforms.median_imputation(ws.frames[5], transforms.Context(task="clustering")))


def standard_scaler_lines(ws):
    sink(transforms.standard_scaler(ws.frames[5], transforms.Context(task="clustering")))


def label_encoding_orders(ws):
    sink(transforms.label_encoding(ws.frames[1], transforms.Context(target="order_state")))


def undersampling_orders(ws):
    sink(resample.random_undersampling(ws.frames[3], transforms.Context(target="order_state")))


BENCH = [
    profile_lines, correlate_lines, duplicate_lines, keyed_rows_orders, multiset_rows_lines, compare_orders, diagnose_orders,
    content_hash_lines, target_associations_orders, median_imputation_lines, standard_scaler_lines, label_encoding_orders, undersampling_orders,
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark: SparkSession = build_session(f"local[{cpus}]", int(cpus))
    ws = Workspace(spark, sf_dir)
    sink(ws.frames[1])  # start the executor threads
    times = {}
    for fn in BENCH:
        start = time.perf_counter()
        fn(ws)
        times[fn.__name__] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "dataset evidence wall time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
