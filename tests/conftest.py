import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from siteledger.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", master="local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


class Tasks:
    """What the tasks of the stages that ran inside a block have read from shuffles."""

    def __init__(self, spark):
        self.spark, self.first = spark, None

    def _stages(self):
        context = self.spark.sparkContext
        context._jsc.sc().listenerBus().waitUntilEmpty(60_000)
        store, gateway = context._jsc.sc().statusStore(), context._gateway
        numbers = gateway.new_array(gateway.jvm.double, 0)
        stages = store.stageList(None, False, False, numbers, gateway.jvm.java.util.ArrayList())
        return store, [stages.apply(i) for i in range(stages.size())]

    def __enter__(self):
        self.first = max((s.stageId() for s in self._stages()[1]), default=-1)
        return self

    def __exit__(self, *_):
        return None

    def most_rows(self) -> int:
        store, stages = self._stages()
        most = 0
        for s in stages:
            if s.stageId() > self.first and s.shuffleReadRecords():
                tasks = store.taskList(s.stageId(), s.attemptId(), 10_000)
                for i in range(tasks.size()):
                    metrics = tasks.apply(i).taskMetrics()
                    if metrics.isDefined():
                        most = max(most, metrics.get().shuffleReadMetrics().recordsRead())
        return most


@pytest.fixture
def tasks(spark):
    return lambda: Tasks(spark)
