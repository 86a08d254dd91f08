"""Prompt files, request manifests, and accounting of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def parse_prompts(lines: DataFrame) -> DataFrame:
    """(idx, prompt) of lines (idx, line): a line that begins with { is JSON with prompt, else text, else nothing; blank lines go."""
    rows = lines.withColumn("line", F.trim("line")).where(F.col("line") != "")
    found = F.coalesce(F.get_json_object("line", "$.prompt"), F.get_json_object("line", "$.text"), F.lit(""))
    return rows.select("idx", F.when(F.startswith("line", F.lit("{")), found).otherwise(F.col("line")).alias("prompt"))


def manifest(prompts: DataFrame, servers: list[str], tag: str, hooks: dict[str, list[int]], model: str = "model", positions: str = "all_prompt", layout: str = "packed", max_tokens: int = 1) -> DataFrame:
    """(request_id, server, body): prompts numbered in order of idx, dealt to servers in turn."""
    n = F.row_number().over(W.orderBy("idx")) - 1
    spec = F.struct(F.create_map(*[x for k, v in sorted(hooks.items()) for x in (F.lit(k), F.array(*map(F.lit, v)))]).alias("hooks"), F.lit(positions).alias("positions"), F.lit(layout).alias("layout"))
    rows = prompts.withColumn("n", n).withColumn("request_id", F.format_string(f"{tag}-%08d", F.col("n")))
    body = F.to_json(F.struct(F.lit(model).alias("model"), F.col("prompt"), F.lit(max_tokens).alias("max_tokens"), F.col("request_id"), spec.alias("capture")))
    return rows.select("request_id", F.get(F.array(*map(F.lit, servers)), (F.col("n") % len(servers)).cast("int")).alias("server"), body.alias("body"))


def accounting(results: DataFrame) -> DataFrame:
    """(outcome, n, files) of results (status, error, partial_error, paths); anything but a clean 200 is to retry."""
    bad = (F.col("status") != 200) | F.col("error").isNotNull() | F.col("partial_error").isNotNull()
    return results.groupBy(F.when(bad, "retry").otherwise("ok").alias("outcome")).agg(F.count("*").alias("n"), F.sum(F.size("paths")).alias("files"))
