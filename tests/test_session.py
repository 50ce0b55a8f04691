"""The session helpers that fits of several threads share."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from types import SimpleNamespace

from staywise.operators.oversample import smote
from staywise.session import ship_code


def test_threads_ship_the_code_once():
    """Spark refuses a second archive of the same name, whatever thread brings it."""
    sent = []

    def add(path: str) -> None:
        time.sleep(0.2)
        sent.append(path)

    context = SimpleNamespace(applicationId="threads", addPyFile=add)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(ship_code, [SimpleNamespace(sparkContext=context)] * 4))
    assert len(sent) == 1


def test_vectors_of_oversampling_are_not_broadcast(spark):
    """Their files are small, their rows are not: only the few points at the cut go through the driver."""
    rows = [(f"c{i}", [float(i % 40), float(i)], int(i % 4 == 0)) for i in range(160)]
    out = smote(spark.createDataFrame(rows, "customerID string, features array<double>, label int"))
    joins = [line for line in out._jdf.queryExecution().sparkPlan().toString().splitlines() if "BroadcastHashJoin" in line]
    assert all("cut_pid" in line for line in joins), joins
    assert out.groupBy("label").count().select("count").distinct().count() == 1
