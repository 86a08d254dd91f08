"""Capture trees as tables.

Sidecars are read as JSON text and flattened to one table of entries, which is filtered and cut
into splits: stretches of whole rows that tasks read by byte range, however large the file.
Stores that tasks can't open themselves are read whole by Spark's binary source.  Three
layouts are told apart by file name:

    {tag}/{request}/{layer}_{hook}.bin + .json    one tensor
    {tag}/{request}/packed*.bin + .json           all tensors of a request, or of a stage of it
    {tag}/shard-*.bin + .json                     many requests; sealed once its .json exists

``write`` is the sink of the same layouts.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from conceptspark.runtime import stored

SIDECAR = (
    "layer int, hook string, shape array<long>, dtype string, layout string, seq long, prompt_token_ids array<int>, "
    "entries array<struct<request_id:string, layer:int, hook:string, offset:long, nbytes:long, shape:array<long>>>"
)
#: Dtype names of sidecars and how their bytes are read; bfloat16 is widened by a shift.
DTYPES = {"float64": "f8", "float32": "f4", "float16": "f2", "bfloat16": "u2", "uint16": "u2", "int8": "i1", "uint8": "u1", "int16": "i2", "int32": "i4", "int64": "i8"}
DEFAULT_DTYPE = "float32"
#: Bytes of a file that a task reads on its own, and that it turns to rows at once.
SPLIT_BYTES, BATCH_BYTES = 128 << 20, 8 << 20
ROWS = "tag string, request_id string, unit string, layer int, hook string, pos long, x array<float>"


def sidecars(spark: SparkSession, root: str, glob: str = "*.json", stream: bool = False) -> DataFrame:
    """(unit, kind, doc): one row per sidecar file under ``root``."""
    reader = spark.readStream if stream else spark.read
    text = reader.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root)
    rows = text.select(F.col("_metadata.file_path").alias("unit"), F.from_json("value", SIDECAR).alias("doc"))
    name = F.element_at(F.split("unit", "/"), -1)
    kind = F.when(name.startswith("packed"), "packed").when(name.startswith("shard-"), "sharded").otherwise("per_file")
    return rows.withColumn("kind", kind)


def entries(files: DataFrame, layer: int | None = None, hook: str | None = None) -> DataFrame:
    """(unit, kind, tag, request_id, layer, hook, dtype, seq, offset, nbytes, rows, d), one row per stored chunk.

    Where several packed indexes of a request hold the same (layer, hook), the last one by
    path stands.
    """
    parts = F.split("unit", "/")
    one = F.array(F.struct(F.lit(None).cast("string").alias("request_id"), F.col("doc.layer").alias("layer"), F.col("doc.hook").alias("hook"), F.lit(0).cast("long").alias("offset"), F.lit(None).cast("long").alias("nbytes"), F.col("doc.shape").alias("shape")))
    rows = files.withColumn("e", F.explode(F.when(F.col("kind") == "per_file", one).otherwise(F.col("doc.entries"))))
    sharded = F.col("kind") == "sharded"
    rows = rows.select(
        "unit", "kind", F.when(sharded, F.element_at(parts, -2)).otherwise(F.element_at(parts, -3)).alias("tag"), F.when(sharded, F.col("e.request_id")).otherwise(F.element_at(parts, -2)).alias("request_id"),
        "e.layer", "e.hook", F.coalesce("doc.dtype", F.lit(DEFAULT_DTYPE)).alias("dtype"), F.coalesce("doc.seq", F.lit(0)).alias("seq"), "e.offset", "e.nbytes", F.get("e.shape", F.lit(0)).alias("rows"), F.get("e.shape", F.lit(1)).alias("d"))
    if layer is not None:
        rows = rows.where(F.col("layer") == layer)
    if hook is not None:
        rows = rows.where(F.col("hook") == hook)
    last = F.max("unit").over(W.partitionBy("tag", "request_id", "layer", "hook", "kind"))
    return rows.withColumn("last", last).where((F.col("kind") != "packed") | (F.col("unit") == F.col("last"))).drop("last")


def units(files: DataFrame, layer: int, hook: str) -> DataFrame:
    """(unit, kind, n): read units that may hold the hook, with their row counts from sidecars alone.

    Packed and sharded units are listed even where they hold no rows of it.
    """
    held = entries(files, layer, hook).groupBy("unit").agg(F.sum("rows").alias("n"))
    every = files.where((F.col("kind") != "per_file") | ((F.col("doc.layer") == layer) & (F.col("doc.hook") == hook)))
    return every.select("unit", "kind").join(held, "unit", "left").select("unit", "kind", F.coalesce("n", F.lit(0)).alias("n"))


def _decode(raw: bytes, rows: int, d: int, dtype: str) -> np.ndarray:
    x = np.frombuffer(raw, dtype=DTYPES[dtype])
    if dtype == "bfloat16":
        x = (x.astype(np.uint32) << 16).view(np.float32)
    return x.reshape(rows, d).astype(np.float32)


def placed(files: DataFrame, layer: int | None = None, hook: str | None = None, request_id: str | None = None) -> DataFrame:
    """Entries with ``start``, the place of their first row among the request's rows of the hook."""
    e = entries(files, layer, hook)
    if request_id is not None:
        e = e.where(F.col("request_id") == request_id)
    before = W.partitionBy("tag", "request_id", "layer", "hook").orderBy("seq", "offset", "unit").rowsBetween(W.unboundedPreceding, -1)
    return e.withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0)))


def row_bytes() -> Column:
    """Bytes of a row of an entry."""
    sizes = F.create_map(*[F.lit(x) for name, kind in DTYPES.items() for x in (name, np.dtype(kind).itemsize)])
    return F.col("d") * F.element_at(sizes, F.col("dtype"))


def splits(placed_: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Stretches of whole rows of ``split_bytes`` at most (one row at least), each read on its own."""
    at_once = F.greatest(F.lit(1), F.floor(F.lit(split_bytes) / row_bytes())).cast("long")
    n = F.ceil(F.col("rows") / at_once).cast("long")
    rows = placed_.where("rows > 0").withColumn("at_once", at_once).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    first = F.col("k") * F.col("at_once")
    return rows.select(
        "tag", "request_id", "unit", F.regexp_replace("unit", r"\.json$", ".bin").alias("path"), "layer", "hook", "dtype", "d", (F.col("offset") + first * row_bytes()).alias("offset"),
        F.least(F.col("at_once"), F.col("rows") - first).alias("rows"), (F.col("start") + first).alias("start"), (F.coalesce("nbytes", F.col("rows") * row_bytes()) - F.col("rows") * row_bytes()).alias("odd"))


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (fs.LocalFileSystem(), path)


def opens(root: str) -> bool:
    """Whether tasks can open files under ``root`` themselves; other stores are read through Spark."""
    try:
        _file_system(root)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def read(spark: SparkSession, root: str, layer: int | None = None, hook: str | None = None, request_id: str | None = None, files: DataFrame | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(tag, request_id, unit, layer, hook, pos, x) of the captured rows.

    ``pos`` counts a request's rows of a hook in order of (shard sequence, offset), over
    all its chunks.  Layer, hook and request choose entries of the sidecars, and only their
    bytes are read: a file of any size is cut into stretches of rows that tasks read on their
    own.  A file shorter than its entries say fails the read.
    """
    files = sidecars(spark, root) if files is None else files
    if not opens(root):
        return _read_whole(spark, root, placed(files, layer, hook, request_id), layer, hook)
    parts = stored(splits(placed(files, layer, hook, request_id), split_bytes), "capture-splits")
    total = parts.agg(F.sum(F.col("rows") * row_bytes())).first()[0] or 0
    tasks = max(1, math.ceil(total / split_bytes), min(parts.count(), spark.sparkContext.defaultParallelism))

    def load(batches):
        for b in batches:
            for c in b.to_pylist():
                if c["odd"]:
                    raise ValueError(f"{c['path']}: an entry's bytes are {c['odd']} more than its rows take")
                width = c["d"] * np.dtype(DTYPES[c["dtype"]]).itemsize
                system, path = _file_system(c["path"])
                with system.open_input_file(path) as f:
                    f.seek(c["offset"])
                    for at in range(0, c["rows"], max(1, BATCH_BYTES // width)):
                        n = min(max(1, BATCH_BYTES // width), c["rows"] - at)
                        raw = f.read(n * width)
                        if len(raw) != n * width:
                            raise ValueError(f"{c['path']} is cut short: [{c['offset'] + at * width}:{c['offset'] + (at + n) * width}] of {f.size()} bytes")
                        x = _decode(raw, n, c["d"], c["dtype"])
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * c["d"]), pa.array(x.ravel()))
                        same = [pa.array([c[k]] * n, kind) for k, kind in (("tag", pa.string()), ("request_id", pa.string()), ("unit", pa.string()), ("layer", pa.int32()), ("hook", pa.string()))]
                        yield pa.RecordBatch.from_arrays([*same, pa.array(c["start"] + at + np.arange(n)), lists], names=["tag", "request_id", "unit", "layer", "hook", "pos", "x"])

    # A number of tasks by bytes to read: the table of splits itself is too small to be cut by size.
    return parts.repartition(tasks, F.xxhash64("path", "offset")).mapInArrow(load, ROWS)


def _read_whole(spark: SparkSession, root: str, e: DataFrame, layer: int | None, hook: str | None) -> DataFrame:
    """``read`` of stores that only Spark opens: a file is one value, of 2 GiB at most."""
    listed = e.groupBy(F.regexp_replace("unit", r"\.json$", ".bin").alias("path")).agg(F.collect_list(F.struct("tag", "request_id", "unit", "layer", "hook", "dtype", "offset", "nbytes", "rows", "d", "start")).alias("es"))
    pattern = f"{layer}_{hook}.bin" if layer is not None and hook is not None else "*.bin"
    glob = "*.bin" if pattern == "*.bin" else f"{{{pattern},packed*.bin,shard-*.bin}}"
    bins = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    joined = listed.join(bins.select(F.col("_metadata.file_path").alias("path"), "content"), "path")

    def decode(batches):
        for pdf in batches:
            for path, es, content in zip(pdf["path"], pdf["es"], pdf["content"]):
                for c in es:
                    width = np.dtype(DTYPES[c["dtype"]]).itemsize
                    size = c["rows"] * c["d"] * width if c["nbytes"] is None or pd.isna(c["nbytes"]) else int(c["nbytes"])
                    raw = content[c["offset"] : c["offset"] + size]
                    if len(raw) != size:
                        raise ValueError(f"{path} is cut short: [{c['offset']}:{c['offset'] + size}] of {len(content)} bytes")
                    x = _decode(raw, c["rows"], c["d"], c["dtype"])
                    yield pd.DataFrame({"tag": c["tag"], "request_id": c["request_id"], "unit": c["unit"], "layer": c["layer"], "hook": c["hook"], "pos": c["start"] + np.arange(len(x)), "x": list(x)})

    return joined.mapInPandas(decode, ROWS)


def write(rows: DataFrame, root: str, tag: str, layout: str = "sharded", dtype: str = "float32", name: str = "packed", shards: int | None = None) -> DataFrame:
    """Write captured rows (request_id, layer, hook, pos, x) in one of the three layouts.

    Returns a table (unit, rows) of what was written.  Shards are ranges of (request, layer,
    hook, pos) and may split a request; the other layouts keep a request's file in one task,
    which streams it.  A file appears whole under its name, and its sidecar after it, so a task
    that is run again replaces its own files, and readers see sealed ones only.
    """
    if layout not in ("per_file", "packed", "sharded"):
        raise ValueError(f"unknown layout {layout!r}")
    if dtype not in DTYPES or dtype == "bfloat16":
        raise ValueError(f"can't write {dtype!r}")
    keys = ["request_id", "layer", "hook", "pos"]
    rows = rows.select(F.col("request_id").cast("string"), F.col("layer").cast("int"), "hook", F.col("pos").cast("long"), F.col("x").cast("array<double>").alias("x"))
    dealt = rows.repartitionByRange(*([shards] if shards else []), *keys) if layout == "sharded" else rows.repartition("request_id")

    def save(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        now: dict = {}
        written = []

        def close():
            if now:
                now["file"].close()
                system, path = now["system"], now["path"]
                system.move(f"{path}.bin.{attempt}", f"{path}.bin")
                with system.open_output_stream(f"{path}.json.{attempt}") as f:
                    f.write(json.dumps(now["doc"]).encode())
                system.move(f"{path}.json.{attempt}", f"{path}.json")
                written.append((f"{now['url']}.json", now["rows"]))
                now.clear()

        def begin(url, doc):
            close()
            system, path = _file_system(url)
            system.create_dir(path.rsplit("/", 1)[0], recursive=True)
            now.update(system=system, path=path, url=url, doc=doc, rows=0, at=0, file=system.open_output_stream(f"{path}.bin.{attempt}"))

        unit = None
        for b in batches:
            at = 0
            said = list(zip(*(b.column(i).to_pylist() for i in range(3))))
            while at < len(said):
                request, layer, hook = key = said[at]
                end = at
                while end < len(said) and said[end] == key:
                    end += 1
                x = np.vstack(b.column(4).slice(at, end - at).to_pylist()).astype(DTYPES[dtype])
                mine = ("shard",) if layout == "sharded" else (request,) if layout == "packed" else key
                if mine != unit:
                    unit = mine
                    if layout == "sharded":
                        begin(f"{root}/{tag}/shard-{part // 1000:03d}-{part % 1000:06d}", {"layout": layout, "dtype": dtype, "seq": part, "entries": []})
                    elif layout == "packed":
                        begin(f"{root}/{tag}/{request}/{name}", {"layout": layout, "dtype": dtype, "entries": []})
                    else:
                        begin(f"{root}/{tag}/{request}/{layer}_{hook}", {"layer": layer, "hook": hook, "dtype": dtype, "shape": [0, x.shape[1]]})
                doc, raw = now["doc"], x.tobytes()
                if layout == "per_file":
                    doc["shape"][0] += len(x)
                else:
                    last = doc["entries"][-1] if doc["entries"] else None
                    if last and (last.get("request_id", request), last["layer"], last["hook"], last["shape"][1]) == (request, layer, hook, x.shape[1]):
                        last["nbytes"] += len(raw)
                        last["shape"][0] += len(x)
                    else:
                        own = {"request_id": request} if layout == "sharded" else {}
                        doc["entries"].append({**own, "layer": layer, "hook": hook, "offset": now["at"], "nbytes": len(raw), "shape": list(x.shape)})
                now["file"].write(raw)
                now["at"] += len(raw)
                now["rows"] += len(x)
                at = end
        close()
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in written], pa.string()), pa.array([n for _, n in written], pa.int64())], names=["unit", "rows"])

    return stored(dealt.sortWithinPartitions(*keys).mapInArrow(save, "unit string, rows long"), "capture-written")


def token_ids(files: DataFrame) -> DataFrame:
    """(unit, pos, token_id) of the prompt tokens in the sidecars."""
    return files.select("unit", F.posexplode("doc.prompt_token_ids").alias("pos", "token_id"))


def short_files(spark: SparkSession, root: str) -> DataFrame:
    """Entries that reach past the end of their file: (unit, end, length)."""
    e = entries(sidecars(spark, root)).where("nbytes is not null")
    ends = e.groupBy("unit").agg(F.max(F.col("offset") + F.col("nbytes")).alias("end"))
    bins = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.bin").load(root)
    sizes = bins.select(F.regexp_replace(F.col("_metadata.file_path"), r"\.bin$", ".json").alias("unit"), "length")
    return ends.join(sizes, "unit").where(F.col("end") > F.col("length"))
