"""Tasks grow in number with the input, not in size; stored buckets are joined where they lie."""

from pyspark.sql import functions as F

from scorecast.operators import predictions as R
from scorecast.plans import registry
from scorecast.session import TASK_BYTES, bound_tasks
from scorecast.sources import batches
from scorecast.sources.tables import Tables

KEYS = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.requireAllClusterKeysForCoPartition")


def _restored(spark, test):
    was = {k: spark.conf.get(k, None) for k in (*KEYS, "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        test()
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_settings_bound_what_a_task_holds(spark):
    def test():
        spark.conf.set(KEYS[0], "128m")
        spark.conf.set(KEYS[1], "8m")
        bound_tasks(spark, 1 << 33)
        assert int(spark.conf.get(KEYS[0])) == 2 * TASK_BYTES
        assert spark.conf.get(KEYS[1]) == "8m"  # a smaller setting stays
        assert int(spark.conf.get(KEYS[2])) == (1 << 33) // (TASK_BYTES // 2)
        bound_tasks(spark, 1)
        assert int(spark.conf.get(KEYS[2])) == (1 << 33) // (TASK_BYTES // 2)

    _restored(spark, test)


def test_buckets_follow_the_input(spark, monkeypatch):
    from scorecast.sources import tables as T

    monkeypatch.setattr(T, "input_bytes", lambda *_: 1 << 30)
    assert Tables(spark, "/nowhere").buckets == 32


def test_deletes_do_not_shuffle_the_stored_predictions(spark, tables):
    def test():
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        registry.load_all()
        registry.QUERIES["next_fixtures"](spark, tables.sf_dir)  # any query sets the session up
        gone = batches.delete_requests(tables)
        left = R.remaining_after_delete(tables.predictions, gone.select("*", F.lit(R.DELETED).alias("status")))
        plan = left._jdf.queryExecution().executedPlan().toString()
        # One exchange for the requests' two parts together, none for the stored side.
        assert plan.count("Exchange hashpartitioning") == 1, plan

    _restored(spark, test)
