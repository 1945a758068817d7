"""What the physical plans must not contain."""

import pytest

from registry.queries import QUERIES

# writing, streaming and training queries run jobs while they are built; their plans are plain file scans
EAGER = {n for n in QUERIES if n.startswith(("stream_", "train_"))} | {
    "detection_log_scan", "detection_log_sink", "system_block_log_sink", "system_block_log_scan", "feed_snapshot_scan",
    "labelled_dataset_sink", "text_feed_scan", "json_feed_scan", "hosts_file_round_trip", "training_csv_scan", "cross_validate", "score_batch", "feature_importance", "model_metadata_sink", "select_model",
}


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_python_and_no_nested_loops(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    for node in ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "BroadcastNestedLoopJoin", "CartesianProduct"):
        assert node not in plan


@pytest.mark.parametrize("name", ["latest_feeds"])
def test_ranks_are_cut_before_the_shuffle(spark, sf_dir, name):
    assert "WindowGroupLimit" in plan_of(QUERIES[name](spark, sf_dir))


@pytest.mark.parametrize("name", ["top_domains", "recent_events", "recent_blocks"])
def test_top_lists_keep_only_their_rows(spark, sf_dir, name):
    assert "TakeOrderedAndProject" in plan_of(QUERIES[name](spark, sf_dir))


@pytest.mark.parametrize("name", ["verdict_cascade", "domain_ip_map"])
def test_large_input_is_shuffled_once(spark, sf_dir, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "ReusedExchange" in plan_of(QUERIES[name](spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_scans_read_only_what_they_need(spark, sf_dir):
    assert "ReadSchema: struct<event_id:bigint>" in plan_of(QUERIES["risk_level"](spark, sf_dir))
