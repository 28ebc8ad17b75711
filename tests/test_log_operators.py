"""Loading, splits, contexts and history rules on hand-made rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from exposura.functions.checks import require_unique, standard_only
from exposura.functions.columns import primary_category
from exposura.operators import audit, contexts, history, popularity, splits
from exposura.sources import artifacts, files, impressions as source
from tests.conftest import rows

BOUNDS = splits.SplitBounds(20220421, (20220422, 20220428), (20220429, 20220508), (20220422, 20220508), 20220428, 20220429)
LOG = "user_id long, item_id long, timestamp_ms long, date int, is_random int, long_view int"


@pytest.fixture
def small(spark):
    data = [
        (1, 10, 1, 20220420, 0, 1), (2, 11, 2, 20220421, 0, 0), (1, 12, 3, 20220422, 0, 1),
        (2, 10, 4, 20220501, 0, 0), (3, 13, 5, 20220501, 1, 1),
    ]
    return spark.createDataFrame(data, LOG)


def test_random_rows_only_in_randomized_split(small):
    split = splits.assign_splits(small, BOUNDS)
    assert split.where("split = 'train'").count() == 2
    assert rows(split.where("is_random = 1"), "split") == [("randomized_test",)]
    assert splits.validate_splits(split).first()["valid"]
    splits.require_valid_splits(split)


def test_date_decides_not_the_clock(small):
    moved = small.withColumn("timestamp_ms", F.when(F.col("date") == 20220422, F.lit(0)).otherwise(F.col("timestamp_ms")))
    assert splits.validate_splits(splits.assign_splits(moved, BOUNDS)).first()["valid"]


def test_row_outside_all_splits_raises(spark, small):
    outside = small.unionByName(spark.createDataFrame([(9, 9, 9, 20230101, 0, 0)], LOG))
    with pytest.raises(Exception, match="outside all split bounds"):
        splits.assign_splits(outside, BOUNDS).collect()


def test_overlapping_dates_and_missing_split_are_invalid(small):
    split = splits.assign_splits(small, BOUNDS)
    late = split.withColumn("date", F.when(F.col("split") == "train", F.lit(20220430)).otherwise(F.col("date")))
    assert not splits.validate_splits(late).first()["valid"]
    with pytest.raises(ValueError):
        splits.require_valid_splits(split.where("split <> 'validation'"))


def test_fits_refuse_random_rows(small):
    with pytest.raises(Exception, match="standard logs only"):
        popularity.popularity(small).collect()
    with pytest.raises(Exception, match="standard logs only"):
        standard_only(small, "anything").collect()


def test_temporal_slice(spark):
    df = spark.createDataFrame([(t,) for t in (1, 1, 2, 3, 4, 5)], "timestamp_ms long")
    assert splits.temporal_cutoff(df, 0.2).first()[0] == 4
    assert splits.temporal_cutoff(df, 0.999).first()[0] == 1
    with pytest.raises(ValueError):
        splits.temporal_cutoff(df, 1.0)
    with pytest.raises(Exception, match="two timestamps"):
        splits.temporal_cutoff(df.where("timestamp_ms = 1"), 0.5).collect()


def test_history_is_strict(spark):
    df = spark.createDataFrame([(1, 10, 100, 1), (2, 10, 100, 0), (1, 10, 101, 0)], "user_id long, item_id long, timestamp_ms long, long_view int")
    found = rows(history.historical_features(df, 2.0), "timestamp_ms", "user_id", "hist_item_exposure", "hist_user_exposure", "hist_item_reward_rate", "feature_cutoff_ms")
    assert found == [(100, 1, 0, 0, 0.0, 99), (100, 2, 0, 0, 0.0, 99), (101, 1, 2, 1, (1 + 2 * 0.5) / 4, 100)]


def test_session_gap_and_window(spark):
    minute = 60_000
    times = [0, 30 * minute, 60 * minute + 1]  # a gap of exactly the limit stays, one more millisecond splits
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(times)], "user_id long, item_id long, timestamp_ms long")
    assert [r["context_id"] for r in contexts.ranking_contexts(df).orderBy("timestamp_ms").collect()] == ["1:0:0", "1:0:0", "1:1:0"]
    many = spark.createDataFrame([(1, i, i) for i in range(21)], "user_id long, item_id long, timestamp_ms long")
    found = contexts.ranking_contexts(many)
    assert rows(found.groupBy("context_id").count()) == [("1:0:0", 20), ("1:0:1", 1)]
    assert rows(found.where("item_id = 20"), "session_position") == [(20,)]


def test_ranker_features_fill_unusable_values(spark):
    df = spark.createDataFrame([(1, 5, 3_600_000, "x", float("nan"))], "user_id long, item_id long, timestamp_ms long, tab string, retrieval_score double")
    train = spark.createDataFrame([(2, 6, 1, 1)], "user_id long, item_id long, timestamp_ms long, long_view int")
    row = history.ranker_features(df, train).first()
    assert (row["tab"], row["retrieval_score"], row["hour"], row["day_of_week"], row["hist_item_exposure"]) == (0.0, 0.0, 1.0, 3.0, 0.0)
    assert set(history.FEATURE_COLUMNS) <= set(row.asDict())


def test_primary_category(spark):
    cases = {
        None: "unknown", "['c1','x']": "c1", "[12, 5]": "12", "('a', 'b')": "a", "c1,c2": "c1", "c1|c2": "c1", "c1;c2": "c1",
        " c1 ": "c1", "[]": "unknown", "": "unknown", "a|b,c": "a|b", "['a,b', 'c']": "a,b", "'q'": "q", "[x, y]": "x",
    }
    df = spark.createDataFrame([(k,) for k in cases], "tag string")
    got = {r["tag"]: r["c"] for r in df.select("tag", primary_category(F.col("tag")).alias("c")).collect()}
    assert got == cases


def test_duplicates_count_all_copies(spark):
    df = spark.createDataFrame([("a", 1, 1, 1)] * 3 + [("a", 1, 1, 2)], "source_log string, user_id long, item_id long, timestamp_ms long")
    assert rows(audit.duplicate_keys(df)) == [(3, 1)]


def test_join_contract(spark):
    with pytest.raises(ValueError, match="more than one row"):
        require_unique(spark.createDataFrame([(1,), (1,)], "user_id long"), ["user_id"])


def _write_logs(spark, folder, flags):
    paths = {}
    for name, flag in flags.items():
        record = dict.fromkeys(source.REQUIRED_COLUMNS, "1") | {"is_rand": flag}
        path = f"{folder}/{name}"
        spark.createDataFrame([tuple(record.values())] * 2, ", ".join(f"{c} string" for c in record)).write.option("header", True).csv(path)
        paths[name] = path
    return paths


def test_csv_logs_load_and_reject_wrong_policy(spark, tmp_path):
    good = source.load_impressions(spark, _write_logs(spark, tmp_path / "good", {"standard_early": "0", "standard_late": "0", "random": "1"}))
    assert good.count() == 6 and dict(good.dtypes)["item_id"] == "bigint"
    summary = source.file_summary(spark.read.option("header", True).csv(str(tmp_path / "good" / "random")))
    assert summary.agg(F.sum("rows")).first()[0] == 2
    for wrong in ("1", "2", "x"):
        paths = _write_logs(spark, tmp_path / f"bad{wrong}", {"standard_early": wrong, "standard_late": "0", "random": "1"})
        with pytest.raises(Exception):
            source.load_impressions(spark, paths).collect()
    with pytest.raises(ValueError, match="no path"):
        source.load_impressions(spark, {"random": "x"})


def test_sinks_and_result_union(spark, small, tmp_path):
    split = splits.assign_splits(small, BOUNDS)
    source.write_splits(split, f"{tmp_path}/splits")
    assert spark.read.parquet(f"{tmp_path}/splits").where("split = 'train'").count() == 2
    source.write_features(split, f"{tmp_path}/features")
    assert spark.read.parquet(f"{tmp_path}/features").where("split = 'train' and date = 20220420").count() == 1
    spark.range(2).write.parquet(f"{tmp_path}/results/popularity_standard")
    spark.range(3).write.parquet(f"{tmp_path}/results/two_part_randomized")
    found = artifacts.union_results(spark, f"{tmp_path}/results").groupBy("model", "domain").count()
    assert rows(found) == [("popularity", "standard", 2), ("two_part", "randomized", 3)]
    for kind in ("json", "csv"):
        artifacts.write_metrics(spark.range(2), f"{tmp_path}/metrics_{kind}", kind)
    assert spark.read.json(f"{tmp_path}/metrics_json").count() == 2
    assert artifacts.artifact_manifest(spark, f"{tmp_path}/results").where("length(sha256) = 64").count() >= 2


HEADER = "user_id,video_id,date,time_ms,is_click,is_like,is_follow,is_comment,is_forward,is_hate,long_view,play_time_ms,duration_ms,is_rand,tab"


def _log_paths(tmp_path, lines, flags=(0, 0, 1)):
    paths = {}
    for name, flag in zip(("standard_early", "standard_late", "random"), flags):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "a.csv").write_text("\n".join([HEADER, f"1,2,20220410,1000,1,0,0,0,0,0,1,10,20,{flag},3"]) + "\n")
        paths[name] = str(folder)
    if lines:
        (tmp_path / "random" / "b.csv").write_text("\n".join(lines) + "\n")
    return paths


def test_loader_refuses_another_column_order(spark, tmp_path):
    swapped = HEADER.replace("user_id,video_id", "video_id,user_id")
    paths = _log_paths(tmp_path, [swapped, "7,8,20220410,1000,1,0,0,0,0,0,1,10,20,1,3"])
    with pytest.raises(Exception):
        source.load_impressions(spark, paths).collect()


@pytest.mark.parametrize("row", ["1,,20220410,1000,1,0,0,0,0,0,1,10,20,1,3", ",2,20220410,1000,1,0,0,0,0,0,1,10,20,1,3", "1,2,20220410,1000,1,0,0,0,0,0,,10,20,1,3"])
def test_loader_refuses_empty_keys_and_labels(spark, tmp_path, row):
    assert source.load_impressions(spark, _log_paths(tmp_path, None)).count() == 3
    (tmp_path / "random" / "b.csv").write_text(f"{HEADER}\n{row}\n")
    with pytest.raises(Exception, match="without one of"):
        source.load_impressions(spark, {n: str(tmp_path / n) for n in ("standard_early", "standard_late", "random")}).collect()


def test_side_tables_refuse_another_column_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("user_id,age\n1,2\n")
    (tmp_path / "b.csv").write_text("age,user_id\n3,4\n")
    with pytest.raises(Exception):
        source.load_side_tables(spark, {"users": str(tmp_path)})["users"].collect()


def test_stored_splits_are_checked_once_and_prune_folders(spark):
    bounds = splits.SplitBounds(20220421, (20220422, 20220428), (20220429, 20220508), (20220422, 20220508), 20220428, 20220429)
    data = [(i, i % 5, 1000 + i, 20220419 + i % 15 if i % 15 < 10 else 20220501, int(i % 15 > 5 and i % 2), i % 2) for i in range(60)]
    schema = "user_id long, item_id long, timestamp_ms long, date int, is_random int, long_view int"
    raw = spark.createDataFrame(data, schema)
    stored = splits.stored_splits(raw, bounds, "pruned")
    assert rows(stored) == rows(splits.assign_splits(raw, bounds)) and stored.columns == [*raw.columns, "split"]
    plan = stored.where("split = 'train' and item_id = 3").select("user_id")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "EqualTo(item_id,3)" in plan
    assert rows(splits.stored_splits(raw.limit(0), bounds, "pruned")) == rows(stored)  # the table of that name is there already
    with pytest.raises(Exception, match="outside all split bounds"):
        splits.stored_splits(raw.withColumn("date", F.lit(20300101)), bounds, "broken")
    sliced = splits.random_domain_slices(stored, bounds)
    assert splits.require_domain_slices(sliced) is sliced
    with pytest.raises(ValueError, match="adaptation"):
        splits.require_domain_slices(sliced.where("domain_slice = 'holdout'"))


@pytest.mark.parametrize("piece", [8 << 20, 7])
def test_files_are_reported_in_bounded_pieces(spark, tmp_path, monkeypatch, piece):
    monkeypatch.setattr(files, "PIECE", piece)
    texts = {
        "a.csv": 'user,"the item",x\n1,"two\nlines, and ""quotes""",3\n4,5,6', "b/c.csv": "u;v\n1;2\n\n", "empty.csv": "",
        "d.jsonl": '{"a": 1}\n{"a": 2}\n', "e.bin": "\x00" * 100, "_SUCCESS": "", "head.tsv": "only\theader",
    }
    for name, text in texts.items():
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, newline="")
    spark.range(5).selectExpr("id", "array(id) as `second one`").coalesce(1).write.parquet(str(tmp_path / "in" / "p"))
    out = {name: files.read_file(str(tmp_path / "in" / name), 0) for name in texts if name != "_SUCCESS"}
    for name, row in out.items():
        assert row[2] == len(texts[name].encode()) and row[3] == hashlib.sha256(texts[name].encode()).hexdigest()
    assert {n: r[4:] for n, r in out.items()} == {
        "a.csv": ("csv", ["user", "the item", "x"], 2), "b/c.csv": ("csv", ["u;v"], 2), "empty.csv": ("csv", [], 0),
        "d.jsonl": ("lines", None, 2), "e.bin": ("other", None, None), "head.tsv": ("csv", ["only", "header"], 0),
    }
    report = files.file_report(spark, str(tmp_path / "in")).collect()
    assert {r.file for r in report if r.kind != "parquet"} == {n.rsplit("/")[-1] for n in out}
    assert [(r.header, r.records) for r in report if r.kind == "parquet"] == [(["id", "second one"], 5)]
    assert spark.read.format(files.FORMAT).load(str(tmp_path / "in")).rdd.getNumPartitions() == len(report)
    (tmp_path / "none").mkdir()
    assert files.file_report(spark, str(tmp_path / "none")).collect() == []
    assert files.file_report(spark, "file:" + str(tmp_path / "in" / "a.csv")).first().records == 2


def test_a_table_that_is_a_folder_of_files_is_one_row(spark, tmp_path):
    spark.range(10).repartition(3).write.parquet(str(tmp_path / "in" / "many.parquet"))
    spark.range(4).coalesce(1).write.parquet(str(tmp_path / "in" / "one.parquet"))
    (tmp_path / "in" / "x.csv").write_text("a,b\n1,2\n")
    (tmp_path / "in" / "x.bin").write_text("?")
    for path in (str(tmp_path / "in"), f"file:{tmp_path}/in/"):
        report = files.table_report(files.file_report(spark, path), path)
        assert rows(report, "table", "files", "kind", "records") == [
            ("many.parquet", 3, "parquet", 10), ("one.parquet", 1, "parquet", 4), ("x.bin", 1, "other", None), ("x.csv", 1, "csv", 1)
        ]
        assert {tuple(r.header) for r in report.where("kind = 'parquet'").collect()} == {("id",)}


def test_window_sizes_from_one_session_pass(spark):
    data = [(u, i, i * 1000 + (i // 17) * 10_000_000, int((u + i) % 9 == 0)) for u in range(4) for i in range(60)]
    log = spark.createDataFrame(data, "user_id long, item_id long, timestamp_ms long, long_view int")
    found = {r.window_size: tuple(r) for r in contexts.window_size_report(log, (4, 10, 6)).collect()}
    for size in (4, 6, 10):
        per = contexts.ranking_contexts(log, 30, size).groupBy("context_id").agg(F.count("*").alias("n"), F.sum("long_view").alias("p")).collect()
        assert found[size] == (size, len(per), 240, sum(r.n >= 2 and r.p > 0 for r in per))
    with pytest.raises(ValueError):
        contexts.window_size_report(log, (5, 0))
