import pytest
from pyspark.sql import functions as F

from spanforge.operators import patch
from spanforge.sources import snapshots


def rows(df):
    return {r.uri: r.text for r in df.collect()}


def test_commits_deletes_conflicts_and_rollback(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    df = lambda *x: spark.createDataFrame(list(x), "uri string, text string")
    assert snapshots.version(spark, root) == 0 and rows(snapshots.read(spark, root)) == {}
    assert snapshots.commit(df(("a", "1"), ("b", "1"), ("b", None)), root, 0) == 1
    assert snapshots.commit(df(("a", None), ("b", "2"), ("c", "")), root, 1) == 2
    assert rows(snapshots.read(spark, root)) == {"b": "2", "c": ""} and rows(snapshots.read(spark, root, 1)) == {"a": "1", "b": "1"}
    with pytest.raises(snapshots.Conflict):  # two writers on one version
        snapshots.commit(df(("z", "z")), root, 1)
    with pytest.raises(Exception, match="half way"):  # a commit that fails while it writes
        snapshots.commit(df(("b", "3"), ("d", "4")).withColumn("text", F.when(F.col("uri") == "d", F.raise_error(F.lit("half way"))).otherwise(F.col("text"))), root, 2)
    with pytest.raises(Exception, match="without a uri"):
        snapshots.commit(df((None, "3")), root, 2)
    assert snapshots.version(spark, root) == 2 and rows(snapshots.read(spark, root)) == {"b": "2", "c": ""}
    assert snapshots.roll_back(spark, root, 1, 2) == 3 and rows(snapshots.read(spark, root)) == {"a": "1", "b": "1"}
    assert snapshots.commit(df(("a", None)), root, 3) == 4 and snapshots.compact(spark, root, 4) == 5
    assert rows(snapshots.read(spark, root)) == {"b": "1"} and len(snapshots._folders(spark, root, 5)) == 1
    with pytest.raises(ValueError, match="no version"):
        snapshots.read(spark, root, 9)


def test_patch_is_committed_whole(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    files = spark.createDataFrame([("a.py", "x = 1\n"), ("b.py", "y = 2\n")], "uri string, text string")
    snapshots.commit(files, root, 0)
    text = "diff --git a/a.py b/a.py\ndeleted file mode 100644\ndiff --git a/b.py b/b.py\n<<<<<<< SEARCH\ny = 2\n=======\ny = 3\n>>>>>>> REPLACE\n"
    done = patch.apply_patch(snapshots.read(spark, root), text)
    assert patch.patch_summary(done).first().failed == 0
    snapshots.commit(done.select("uri", "text"), root, 1)
    assert rows(snapshots.read(spark, root)) == {"b.py": "y = 3\n"}
