import pytest

from actloom import lineage


def test_workspaces_are_deleted(spark):
    work = lineage.Workspace(spark, "own")
    table = work.write(spark.range(3), "rows")
    assert table.count() == 3 and work.has("rows")
    work.drop("rows")
    assert not work.has("rows")
    work.write(spark.range(3), "rows")
    lineage.clean()
    assert not work.has("") and not lineage._open


class Cluster:
    """A session of a cluster that names no folder."""

    class conf:
        get = staticmethod(lambda name, default: default)

    class sparkContext:
        master, applicationId = "spark://host:7077", "x"
        getConf = staticmethod(lambda: {})


def test_a_cluster_must_name_a_folder():
    with pytest.raises(ValueError):
        lineage.shared_folder(Cluster)
