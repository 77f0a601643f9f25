"""Runs, registries, caches and streams by cases of their own."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import text as tx
from tessella.functions.markers import MARKERS
from tessella.operators import rating, relational, runs, synthesis
from tessella.session import shared_folder
from tessella.sources import catalogs, files


def test_cached_tables_serve_stale_rows_on_errors():
    now, calls = [0.0], []

    def load():
        calls.append(now[0])
        if len(calls) == 2:
            raise OSError("down")
        return f"rows {len(calls)}"

    cached = runs.Cached(load, 60, lambda: now[0])
    assert cached.get() == "rows 1" and not cached.stale
    now[0] = 59.0
    assert cached.get() == "rows 1" and len(calls) == 1
    now[0] = 61.0
    assert cached.get() == "rows 1" and cached.stale and isinstance(cached.error, OSError)
    assert cached.get() == "rows 3" and not cached.stale and cached.error is None
    assert runs.Cached(lambda: 1 / 0).get() is None


def test_a_stream_stops_at_the_first_unhealthy_batch(spark, tmp_path):
    spark.range(4).coalesce(1).write.json(str(tmp_path / "in"))
    rows = spark.readStream.schema("id long").json(str(tmp_path / "in"))

    def health(batch):
        if not batch.filter("id = 3").isEmpty():
            raise ValueError("unhealthy")

    with pytest.raises(Exception, match="unhealthy"):
        files.append_stream(rows, str(tmp_path / "out"), str(tmp_path / "mark"), health).awaitTermination()
    assert not (tmp_path / "out").exists()
    files.append_stream(rows, str(tmp_path / "plain"), str(tmp_path / "mark2")).awaitTermination()
    assert spark.read.json(str(tmp_path / "plain")).count() == 4


def test_checkpoint_filters(spark):
    rows = [(0, "pirate_final", "pirate", "dpo"), (1, "pirate_sft", "pirate", "sft"), (2, "pirate_old", "pirate", "dpo"), (3, "sage_dpo", "sage", "dpo")]
    df = spark.createDataFrame(rows, "pos int, name string, persona string, type string")
    newest = lambda d: {r["persona"]: r["name"] for r in relational.first_per_key(d, ["persona"], "pos").collect()}
    assert newest(df) == {"pirate": "pirate_final", "sage": "sage_dpo"}
    assert newest(relational.filter_entries(df, kind="sft")) == {"pirate": "pirate_sft"}
    assert [r["name"] for r in relational.filter_entries(df, query="SAGE").collect()] == ["sage_dpo"]
    assert relational.filter_entries(df, "nobody").count() == 0


def test_delete_takes_one_row_whatever_it_holds(spark):
    rows = [(3, "a", None, {"k": "v"}), (2, "a", None, {"k": "v"}), (1, "a", "x", None), (1, None, "x", None), (5, "b", None, {})]
    df = spark.createDataFrame(rows, "seq int, name string, path string, metadata map<string,string>")
    left = relational.delete_first(df, "name", "a", F.desc("seq")).collect()
    assert sorted((r["seq"], r["name"]) for r in left if r["name"]) == [(1, "a"), (2, "a"), (5, "b")] and len(left) == 4
    assert relational.delete_first(df, "name", "none", "seq").count() == 5
    twins = spark.createDataFrame([(1, "a"), (1, "a")], "seq int, name string")
    assert relational.delete_first(twins, "name", "a", "seq").count() == 1


def test_register_numbers_ties_by_all_columns(spark):
    log = spark.createDataFrame([(4, "x", "y")], "sequence long, name string, path string")
    more = spark.createDataFrame([("a", "q"), ("a", "b"), ("a", None)], "name string, path string")
    out = {r["sequence"]: r["path"] for r in relational.register(log, more).collect()}
    assert out == {4: "y", 5: None, 6: "b", 7: "q"}


def test_trailing_rate_does_not_see_the_stretches(spark):
    rows = [(k % 2, 37 * k, 3 * k) for k in range(400)]
    df = spark.createDataFrame(rows, "g int, s long, total long").withColumn("at", F.timestamp_seconds("s"))
    out = [{(r["g"], r["s"]): r["rate"] for r in relational.trailing_rate(df, "g", "at", "total", 5, frames=n).collect()} for n in (1, 3, 10_000)]
    assert out[0] == out[1] == out[2] and len(out[0]) == 400


def test_bootstrap_repeats_itself(spark):
    df = spark.createDataFrame([(i, "tuned" if i % 3 else "base") for i in range(60)], "k int, winner string")
    one, two = (rating.elo_bootstrap(df, ["k"], replicas=20).collect()[0] for _ in range(2))
    assert one == two and one["tuned_mean"] > one["base_mean"] and one["n"] == 60
    assert rating.elo_bootstrap(df, ["k"], replicas=20, seed=1).collect()[0] != one
    empty = rating.elo_bootstrap(df.filter("false"), ["k"]).collect()[0]
    assert (empty["tuned_mean"], empty["tuned_std"], empty["n"]) == (1000.0, 0.0, 0)
    with pytest.raises(Exception, match="winner"):
        rating.elo_bootstrap(df.withColumn("winner", F.lit("")), ["k"]).collect()


def test_active_runs_fall_back_to_all(spark):
    df = spark.createDataFrame([("a", True, 0, 0), ("b", False, 3, 0), ("c", False, 0, 0)], "name string, active boolean, pairs int, examples int")
    names = lambda d: sorted(r["name"] for r in d.collect())
    assert names(runs.active_runs(df)) == ["a"] and names(runs.active_runs(df.filter("not active"))) == ["b", "c"]
    assert names(runs.runs_shown(df, False)) == ["a"] and names(runs.runs_shown(df, True)) == ["a", "b"]
    assert names(runs.runs_shown(df.filter("name = 'c'"), True)) == ["c"] and names(runs.active_runs(df.filter("false"))) == []


def test_prompts_are_distinct_and_too_few_raise(spark):
    out = [(r["ordinal"], r["prompt"]) for r in synthesis.prompts(spark, 50, seed=3).collect()]
    assert sorted(o for o, _ in out) == list(range(50)) and len({p for _, p in out}) == 50
    assert sorted(out) == sorted((r["ordinal"], r["prompt"]) for r in synthesis.prompts(spark, 50, seed=3).collect())
    with pytest.raises(Exception, match="too few"):
        synthesis.prompts(spark, 5, templates=("one",), pools={}, cues=()).collect()
    assert synthesis.template_reflections(spark, 10_000).count() == len(synthesis.SCENES) * len(synthesis.FRAMES) * len(synthesis.STYLES)


def test_names_and_markers(spark):
    df = spark.createDataFrame([("--A b!--",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(tx.generated_slug(F.col("x"))).collect()] == ["a-b", "llm-character", "llm-character"]
    assert len(MARKERS) == 13 and all(MARKERS.values())


def test_sorting_ignores_case_before_it_looks_at_it(spark):
    df = spark.createDataFrame([("b", "sft"), ("B", "dpo"), ("a", "x"), ("C", "x")], "persona string, type string")
    assert [r["persona"].lower() for r in runs.sorted_entries(df).collect()] == ["a", "b", "b", "c"]


def test_shared_folder_is_kept(spark):
    assert shared_folder(spark) == shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_tensor_files_by_candidates(spark, tmp_path):
    content = catalogs.encoded({"a": np.arange(6, dtype=np.float32).reshape(2, 3), "b": np.zeros(0, np.float32)})
    (tmp_path / "model.safetensors").write_bytes(content)
    rows = {r["key"]: (r["shape"], r["numbers"]) for r in catalogs.read_tensors(spark, str(tmp_path)).collect()}
    assert rows == {"a": ([2, 3], [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]), "b": ([0], [])}
    half = np.array([1.0, -2.5], np.float32).view("<u4") >> 16
    head = b'{"__metadata__":{},"w":{"dtype":"BF16","shape":[2],"data_offsets":[0,4]}}'
    (tmp_path / "adapter_model.safetensors").write_bytes(len(head).to_bytes(8, "little") + head + half.astype("<u2").tobytes())
    assert [r["numbers"] for r in catalogs.read_tensors(spark, str(tmp_path)).collect()] == [[1.0, -2.5]]
    assert catalogs.read_tensors(spark, str(tmp_path / "model.safetensors")).count() == 2
    with pytest.raises(FileNotFoundError):
        catalogs.read_tensors(spark, str(tmp_path / "none"))
