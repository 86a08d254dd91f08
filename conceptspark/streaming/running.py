"""Structured Streaming over firings and captures: counters, silence, moving scales, sealed shards."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptspark.sources import captures


def fire_counts(firings: DataFrame) -> DataFrame:
    """Running (g, n_fire, sum_act, max_act); algebraic, so state is one row per concept."""
    return firings.groupBy("g").agg(F.count("*").alias("n_fire"), F.sum("act").alias("sum_act"), F.max("act").alias("max_act"))


def moments(acts: DataFrame) -> DataFrame:
    """Running (dim, n, s, ss) from which normalisation statistics follow."""
    return acts.select(F.posexplode("x").alias("dim", "v")).groupBy("dim").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss"))


def stats_of(moments_: DataFrame) -> DataFrame:
    """(n, d, scale) of running moments."""
    mean = F.col("s") / F.col("n")
    one = moments_.agg(F.max("n").alias("n"), F.count("*").alias("d"), F.sum(F.col("ss") / F.col("n")).alias("sq"), F.sum(mean * mean).alias("mm"))
    return one.select("n", "d", F.sqrt(F.col("d") / F.greatest(F.col("sq") - F.col("mm"), F.lit(1e-12))).alias("scale"))


class BatchState:
    """State tables of a foreachBatch job, one folder per batch.

    A batch counts once its record stands in ``done``, which is one file of its own that is
    never overwritten.  A batch that failed before that is run again from the tables before
    it and overwrites its own; one that was done is left as it is.  So state counts every
    batch once, and readers never see a half-written table.
    """

    def __init__(self, path: str):
        self.path = path

    def last(self, spark: SparkSession) -> int:
        """The last batch that is done, or -1."""
        try:
            return spark.read.schema("batch int").parquet(f"{self.path}/done").agg(F.max("batch")).first()[0]
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return -1
            raise

    def at(self, spark: SparkSession, first: int, last: int, schema: str) -> DataFrame:
        """The rows of batches ``first`` to ``last``."""
        paths = [f"{self.path}/batch={n}" for n in range(max(first, 0), last + 1)]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def before(self, spark: SparkSession, batch: int, schema: str) -> DataFrame:
        return self.at(spark, batch - 1, batch - 1, schema)

    def put(self, df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        if batch <= self.last(spark):
            return
        df.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        self.seal(spark, batch)

    def seal(self, spark: SparkSession, batch: int) -> None:
        spark.range(1).coalesce(1).select(F.lit(0).alias("one")).write.mode("overwrite").parquet(f"{self.path}/done/batch={batch}")

    def current(self, spark: SparkSession, schema: str) -> DataFrame:
        return self.before(spark, self.last(spark) + 1, schema)


#: (concept, the clock when it last fired); the row without a concept is the clock itself.
SEEN = "g string, at long"
#: Batches between whole tables; the others hold only the concepts that fired in them.
SNAPSHOT = 16


def _seen(spark: SparkSession, state: BatchState, last: int, snapshot: int) -> DataFrame:
    """What stands after batch ``last``, from the last whole table on."""
    rows = state.at(spark, last - last % snapshot, last, SEEN)
    return rows.groupBy("g").agg(F.max("at").alias("at"))


def silence(state: BatchState, snapshot: int = SNAPSHOT):
    """foreachBatch function: tokens since each concept last fired, at the grain of batches.

    The clock is the number of tokens so far.  A batch writes the clock and its own concepts,
    so its cost follows the batch; every ``snapshot`` batches the table is written whole.
    Rows without a concept move the clock alone.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        n = batch.select("token_id").distinct().count()
        old = _seen(spark, state, number - 1, snapshot) if number else spark.createDataFrame([], SEEN)
        clock = n + (old.where("g is null").agg(F.max("at")).first()[0] or 0)
        fired = batch.select(F.col("g").cast("string").alias("g")).where("g is not null").distinct()
        rows = fired.unionByName(spark.createDataFrame([(None,)], "g string")).select("g", F.lit(clock).cast("long").alias("at"))
        if number % snapshot == 0:
            rows = rows.unionByName(old).groupBy("g").agg(F.max("at").alias("at"))
        state.put(rows, number)

    return run


def silence_now(spark: SparkSession, state: BatchState, snapshot: int = SNAPSHOT) -> DataFrame:
    """(g, since) after the last batch that is done; empty before the first."""
    last = state.last(spark)
    seen = _seen(spark, state, last, snapshot) if last >= 0 else spark.createDataFrame([], SEEN)
    clock = seen.where("g is null").select(F.col("at").alias("clock"))
    return seen.where("g is not null").crossJoin(F.broadcast(clock)).select("g", (F.col("clock") - F.col("at")).alias("since"))


SCALE = "scale double"


def moving_scale(state: BatchState, momentum: float = 0.99, floor: float = 1e-6):
    """foreachBatch function: moving mean of activations, one value per batch."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        mean = batch.agg(F.avg("act").alias("m"))
        old = state.before(spark, number, SCALE).agg(F.max("scale").alias("scale"))
        new = F.coalesce(momentum * F.col("scale") + (1 - momentum) * F.col("m"), F.col("m"), F.col("scale"))
        state.put(mean.crossJoin(old).select(F.greatest(new, F.lit(floor)).alias("scale")), number)

    return run


def sealed_shards(spark: SparkSession, root: str, layer: int, hook: str, out: str, checkpoint: str):
    """Stream of captured rows: a shard's rows appear once its sidecar exists."""
    files = captures.sidecars(spark, root, "shard-*.json", stream=True)

    def run(batch: DataFrame, number: int) -> None:
        rows = captures.read(batch.sparkSession, root, layer, hook, files=batch)
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
