"""Capture trees of all layouts, written here and read back."""

import json

import numpy as np
import pytest

from conceptspark.sources import captures
from conceptspark.streaming import running


def _write(path, raw, doc):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.with_suffix(".bin").write_bytes(raw)
    path.with_suffix(".json").write_text(json.dumps(doc))


@pytest.fixture()
def tree(tmp_path):
    rng = np.random.default_rng(0)
    one = rng.standard_normal((3, 4)).astype(np.float32)
    _write(tmp_path / "t/r1/8_resid.bin", one.tobytes(), {"layer": 8, "hook": "resid", "shape": [3, 4]})
    _write(tmp_path / "t/r1/9_resid.bin", one.tobytes(), {"layer": 9, "hook": "resid", "shape": [3, 4], "dtype": "float32"})
    a, b, other = (rng.standard_normal((n, 4)).astype(np.float32) for n in (3, 2, 2))
    raw = a.tobytes() + other.tobytes() + b.tobytes()
    entry = lambda hook, offset, x: {"layer": 8, "hook": hook, "offset": offset, "nbytes": x.nbytes, "shape": list(x.shape)}
    _write(tmp_path / "t/r2/packed.bin", raw, {"layout": "packed", "dtype": "float32", "prompt_token_ids": [5, 6], "entries": [entry("resid", a.nbytes + other.nbytes, b), entry("mlp", a.nbytes, other), entry("resid", 0, a)]})
    half = rng.integers(0, 1 << 15, (4, 4)).astype(np.uint16)
    s = {"layout": "sharded", "dtype": "bfloat16", "seq": 1, "entries": [{**entry("resid", 0, half[:1]), "request_id": "r3"}, {**entry("resid", half[:1].nbytes, half[1:]), "request_id": "r4"}]}
    _write(tmp_path / "t/shard-000-000001.bin", half.tobytes(), s)
    _write(tmp_path / "t/shard-000-000000.bin", half[2:].tobytes(), {**s, "seq": 0, "entries": [{**entry("resid", 0, half[2:]), "request_id": "r3"}]})
    wide = (half.astype(np.uint32) << 16).view(np.float32)
    return tmp_path, {"r1": one, "r2": np.vstack([a, b]), "r3": np.vstack([wide[2:], wide[:1]]), "r4": wide[1:]}


def test_all_layouts(spark, tree):
    root, want = tree
    rows = captures.read(spark, str(root), 8, "resid").toPandas()
    assert set(rows["request_id"]) == set(want)
    for r, x in want.items():
        got = rows[rows["request_id"] == r].sort_values("pos")
        assert list(got["pos"]) == list(range(len(x)))
        np.testing.assert_array_equal(np.vstack(got["x"]), x)
    one = captures.read(spark, str(root), 8, "resid", request_id="r2").toPandas()
    assert len(one) == 5


def test_units_from_sidecars(spark, tree):
    root, _ = tree
    n = {r["unit"].rsplit("/", 1)[1]: (r["kind"], r["n"]) for r in captures.units(captures.sidecars(spark, str(root)), 8, "resid").collect()}
    assert n == {"8_resid.json": ("per_file", 3), "packed.json": ("packed", 5), "shard-000-000001.json": ("sharded", 4), "shard-000-000000.json": ("sharded", 2)}
    ids = captures.token_ids(captures.sidecars(spark, str(root))).orderBy("pos").collect()
    assert [r["token_id"] for r in ids] == [5, 6]


def test_last_stage_wins(spark, tmp_path):
    for k, v in (("packed-pp0", 1.0), ("packed-pp1", 2.0)):
        x = np.full((2, 3), v, dtype=np.float32)
        _write(tmp_path / f"t/r/{k}.bin", x.tobytes(), {"layout": "packed", "dtype": "float32", "entries": [{"layer": 1, "hook": "h", "offset": 0, "nbytes": x.nbytes, "shape": [2, 3]}]})
    rows = captures.read(spark, str(tmp_path), 1, "h").collect()
    assert [r["x"][0] for r in rows] == [2.0, 2.0]


def test_truncation(spark, tree):
    root, _ = tree
    p = root / "t/r2/packed.bin"
    p.write_bytes(p.read_bytes()[:-8])
    assert captures.short_files(spark, str(root)).count() == 1
    with pytest.raises(Exception, match="cut short"):
        captures.read(spark, str(root), 8, "resid").collect()


def test_only_sealed_shards_stream(spark, tree, tmp_path_factory):
    root, want = tree
    out = tmp_path_factory.mktemp("out")
    late = root / "t/shard-000-000001.json"
    text = late.read_text()
    late.unlink()
    run = lambda: running.sealed_shards(spark, str(root), 8, "resid", str(out / "rows"), str(out / "check")).awaitTermination()
    run()
    assert spark.read.parquet(str(out / "rows")).count() == 2
    late.write_text(text)
    run()
    assert spark.read.parquet(str(out / "rows")).count() == 6


def test_a_file_reads_in_many_tasks(spark, tree):
    root, want = tree
    rows = captures.read(spark, str(root), 8, "resid", split_bytes=16)
    assert rows.rdd.getNumPartitions() > 5
    for r, x in want.items():
        got = rows.where(f"request_id = '{r}'").orderBy("pos").collect()
        np.testing.assert_array_equal(np.array([g["x"] for g in got]), x)
    cut = captures.splits(captures.placed(captures.sidecars(spark, str(root)), 8, "resid"), 16)
    assert {r["rows"] for r in cut.collect()} <= {1, 2} and cut.agg({"rows": "sum"}).first()[0] == 14


@pytest.mark.parametrize("layout,dtype", [("per_file", "float32"), ("packed", "float64"), ("sharded", "float16")])
def test_what_is_written_is_read(spark, tmp_path, layout, dtype):
    rng = np.random.default_rng(5)
    rows = [(f"r{r}", 4 + h, "hook", p, [float(v) for v in rng.integers(-8, 8, 3 + h)]) for r in range(4) for h in range(2) for p in range(r * 3)]
    df = spark.createDataFrame(rows, "request_id string, layer int, hook string, pos long, x array<double>").repartition(3)
    report = captures.write(df, str(tmp_path), "t", layout, dtype, shards=5)
    assert report.agg({"rows": "sum"}).first()[0] == len(rows)
    captures.write(df, str(tmp_path), "t", layout, dtype, shards=5)
    got = {(r["request_id"], r["layer"], r["pos"]): list(r["x"]) for r in captures.read(spark, str(tmp_path), split_bytes=40).collect()}
    assert got == {(r, layer, p): x for r, layer, _, p, x in rows}
    assert captures.short_files(spark, str(tmp_path)).count() == 0
    with pytest.raises(ValueError):
        captures.write(df, str(tmp_path), "t", "other")


def test_statistics_are_computed_once(spark, tmp_path):
    from conceptspark.operators import artifact

    asked = []

    def compute():
        asked.append(1)
        return spark.createDataFrame([(len(asked), 2.0)], "n int, scale double")

    key = {"layer": 3, "hook": "a/b", "drop_first": 1}
    stats = lambda k, again=False: artifact.cached_stats(spark, str(tmp_path), k, compute, again).first()["n"]
    assert [stats(key), stats(key), stats({**key, "drop_first": 2}), stats(key, True), stats(key)] == [1, 1, 2, 3, 3]
