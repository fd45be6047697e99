import glob
import time

import pytest

from ledgercheck.session import PLAN_SETTINGS, TABLE_SETTINGS, tune, tune_tables, work_folder


@pytest.fixture
def own(spark):
    """Plan settings as they were, whatever a test does to them."""
    names = [*PLAN_SETTINGS, *TABLE_SETTINGS]
    before = {name: spark.conf.get(name) for name in names}
    yield spark
    for name, value in before.items():
        spark.conf.set(name, value)


def test_tables_are_sent_to_all_executors_by_their_size_there(own):
    """Keys that take 2 MB in a file and many times that as rows are not broadcast."""
    folder = work_folder(own, "keys")
    own.range(500_000).selectExpr("concat('C:', lpad(id, 10, '0')) AS k", "id").write.parquet(folder)

    def plan():
        keys = own.read.parquet(folder)
        return keys.alias("x").join(keys.alias("y"), "k")._jdf.queryExecution().sparkPlan().toString()

    tune(own)
    assert "BroadcastHashJoin" in plan()
    tune_tables(own)
    assert "BroadcastHashJoin" not in plan()


def test_shuffle_files_go_with_the_table_they_made(own):
    """A frame that is asked for twice gives its rows twice."""
    folders = list(own.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager()
                   .diskBlockManager().localDirsString())

    def kept():
        return sum(len(glob.glob(f"{folder}/*/shuffle_*.data")) for folder in folders)

    tune_tables(own)
    before = kept()
    own.range(1000).repartition(7, "id").write.parquet(work_folder(own, "shuffled"))
    for _ in range(50):
        if kept() <= before:
            break
        time.sleep(0.2)
    assert kept() <= before
    same = own.range(1000).repartition(5, "id").groupBy("id").count()
    assert len(same.collect()) == len(same.collect()) == 1000
