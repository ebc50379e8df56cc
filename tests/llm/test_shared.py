"""The shared folder comes from the session; only local sessions may lack one. Joins on ids of either size."""

from types import SimpleNamespace

import pytest

from rxcover.llm.shared import keep_ids, shared_folder, stored


class Context:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = f"file:{folder}"


def session(context, **conf):
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, other: conf.get(key, other)))


def test_the_setting_is_used():
    found = session(Context("yarn", "hdfs:///other"), **{"spark.checkpoint.dir": "hdfs:///shared/"})
    assert shared_folder(found) == "hdfs:///shared"


def test_the_folder_of_the_context_is_used():
    assert shared_folder(session(Context("yarn", "hdfs:///kept"))) == "hdfs:///kept"


def test_a_cluster_without_a_folder_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session(Context("spark://host:7077")))


def test_a_local_session_gets_a_temporary_folder():
    assert "rxcover-checkpoint-" in shared_folder(session(Context("local[4]")))


def test_stored_keeps_rows_and_types(spark):
    frame = spark.createDataFrame([(1, None, [1.5]), (2, "x", None)], "a long, b string, c array<double>")
    kept = stored(frame, "test")
    assert kept.dtypes == frame.dtypes and sorted(kept.collect()) == sorted(frame.collect())
    assert stored(frame.limit(0), "test").count() == 0


@pytest.mark.parametrize("count", [3, 10**9])
def test_keep_ids(spark, count):
    frame = spark.createDataFrame([(1,), (2,), (2,), (None,)], "doc_id long")
    ids = spark.createDataFrame([(2,), (5,), (None,)], "doc_id long")
    assert [r[0] for r in keep_ids(frame, ids, "doc_id", count).collect()] == [2, 2]
    assert sorted(r[0] or 0 for r in keep_ids(frame, ids, "doc_id", count, anti=True).collect()) == [0, 1]
