import os
import re
import time

import pytest
from pyspark.sql import functions as F

from firmlens.functions import lineage


class Session:
    def __init__(self, **settings):
        self.conf = self
        self.settings = settings

    def get(self, key, default=None):
        return self.settings.get(key.replace(".", "_"), default)


def test_shared_folder():
    both = Session(spark_checkpoint_dir="hdfs:///stages", spark_sql_warehouse_dir="hdfs:///warehouse")
    assert lineage.shared_folder(both) == "hdfs:///stages"
    assert lineage.shared_folder(Session(spark_sql_warehouse_dir="hdfs:///warehouse")) == "hdfs:///warehouse"


def test_cut_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, ["a"], None)], "i int, a array<string>, n decimal(38,2)")
    again = lineage.cut(df)
    assert again.schema.simpleString() == df.schema.simpleString()
    assert again.collect() == df.collect()


def _tables(spark):
    return set(os.listdir(lineage.shared_folder(spark).removeprefix("file:")))


def test_settled_drops_the_tables_on_its_way(spark):
    before = _tables(spark)

    def inner():
        return lineage.cut(lineage.cut(spark.range(3)).where("id > 0"))

    def outer():
        found = lineage.settled(spark, inner)
        assert len(_tables(spark) - before) == 1
        return lineage.cut(found).unionByName(found)

    assert sorted(r.id for r in lineage.settled(spark, outer).collect()) == [1, 1, 2, 2]
    assert len(_tables(spark) - before) == 1
    with pytest.raises(ValueError):
        lineage.settled(spark, lambda: 1 / 0 if lineage.cut(spark.range(2)).isEmpty() else int("x"))
    assert len(_tables(spark) - before) == 1


def test_recurring_lines_and_near_duplicates_leave_only_what_is_read(spark):
    line_templates = pytest.importorskip("firmlens.llm.line_templates")
    near_dup = pytest.importorskip("firmlens.llm.near_dup")
    text = "one two three four five six seven\neight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, text), (2, text), (3, "a b c d e"), (4, None)], "doc_id long, text string")
    before = _tables(spark)
    found = line_templates.find_recurring(docs)
    assert len(_tables(spark) - before) == 1
    assert sorted((r.doc_id, r.n_dropped) for r in line_templates.report(docs, found).collect()) == [(1, 0), (2, 2), (3, 0), (4, 0)]
    before = _tables(spark)
    classes = near_dup.components(docs)
    assert len(_tables(spark) - before) == 2
    assert sorted((r.doc_id, r.component_id) for r in classes.collect()) == [(1, 1), (2, 1), (3, 3), (4, 4)]


def _shuffles_on_disk(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return set(re.findall(r"shuffle_\d+", files.mkString(" ")))


def test_cut_leaves_no_shuffle_files(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting, before = spark.conf.get(name), _shuffles_on_disk(spark)
    counted = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    assert lineage.cut(counted).count() == 7
    waited = time.time() + 10
    # Files go soon after the query; one is of the count above, which is no table.
    while len(_shuffles_on_disk(spark) - before) > 1 and time.time() < waited:
        time.sleep(0.2)
    assert len(_shuffles_on_disk(spark) - before) <= 1
    assert spark.conf.get(name) == setting
    assert sorted(r["count"] for r in counted.collect()) == [142, 143, 143, 143, 143, 143, 143]


def test_kept_documents_leave_only_their_ids(spark):
    near_dup = pytest.importorskip("firmlens.llm.near_dup")
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(1, text), (2, text), (3, "a b c d e"), (None, text)], "doc_id long, text string")
    before = _tables(spark)
    kept = near_dup.drop_near_duplicates(docs)
    assert len(_tables(spark) - before) == 1
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3]
