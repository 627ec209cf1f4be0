"""Names of states and grades."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, by number.
GROUP_STATES = ("Stable", "Rebalancing", "Empty", "Dead")
CONSUMER_STATES = ("Active", "Inactive", "Rebalancing", "Leaving")


def _named(code: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, names)), F.when(code >= 0, code.cast("int") + 1).otherwise(F.lit(len(names) + 1))), F.lit("Unknown"))


def group_state(code: Column) -> Column:
    return _named(code, GROUP_STATES)


def consumer_state(code: Column) -> Column:
    return _named(code, CONSUMER_STATES)


def throughput_verdict(rate: Column) -> Column:
    return F.when(rate >= 50_000, "EXCELLENT").when(rate >= 30_000, "GOOD").otherwise("NEEDS IMPROVEMENT")


def metric_key(topic: Column, partition: Column) -> Column:
    """The name that a partition's metrics are kept under."""
    return F.concat_ws("-", topic, partition.cast("string"))


def leader_path(topic: Column, partition: Column, root: str = "") -> Column:
    """The key that a partition's leader holds."""
    return F.concat_ws("/", F.lit(f"{root}/leader"), topic, partition.cast("string"))


def load_key(worker: Column, number: Column) -> Column:
    """The key of a load generator's message."""
    return F.concat_ws("-", F.lit("key"), worker.cast("string"), number.cast("string"))
