"""The engine's switches and hints. Catalyst decides what they would decide, so most change nothing."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

#: Hints that a query may carry; each takes a boolean.
HINTS = ("SORT_ON_VE", "PROJECT_ON_VE", "FILTER_ON_VE", "AGGREGATE_ON_VE", "EXCHANGE_ON_VE", "FAIL_FAST", "JOIN_ON_VE", "AMPLIFY_BATCHES", "SKIP_VE")


@dataclass(frozen=True)
class EngineConf:
    """Accepted switches. `amplify` and the batch sizes map to Spark settings; the others are accepted and do nothing."""

    aggregate: bool = True
    sort: bool = False
    project: bool = False
    filter: bool = False
    exchange: bool = False
    pass_through: bool = False
    fail_fast: bool = False
    join: bool = False
    amplify: bool = True
    rewrite_enabled: bool = True
    column_batch_size: int = 10_000
    target_batch_size_mb: int = 64

    def apply(self, spark: SparkSession) -> SparkSession:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(self.amplify).lower())
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", f"{self.target_batch_size_mb}m")
        spark.conf.set("spark.sql.inMemoryColumnarStorage.batchSize", str(self.column_batch_size))
        return spark

    @classmethod
    def from_options(cls, options: dict[str, str]) -> EngineConf:
        """From names in kebab or snake case; unknown names are refused."""
        kinds = {f.name: type(f.default) for f in fields(cls)}
        read = {k.replace("-", "_"): v for k, v in options.items()}
        if unknown := read.keys() - kinds.keys():
            raise ValueError(f"unknown switches: {sorted(unknown)}")
        return cls(**{k: str(v).lower() == "true" if kinds[k] is bool else int(v) for k, v in read.items()})


def metrics(df: DataFrame) -> dict[str, dict[str, int]]:
    """Spark's SQL metrics of an executed plan's operators, by node name (run an action on this DataFrame first), and
    `operators`, how many of the name there are. Batches and rows are among the metrics of nodes that count them."""
    out: dict[str, dict[str, int]] = {}
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        found, it = out.setdefault(node.nodeName(), {}), node.metrics().iterator()
        found["operators"] = found.get("operators", 0) + 1
        while it.hasNext():
            kv = it.next()
            found[kv._1()] = found.get(kv._1(), 0) + kv._2().value()
        children = node.children().iterator()
        while children.hasNext():
            todo.append(children.next())
    return out
