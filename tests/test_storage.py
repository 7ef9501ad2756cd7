import os

import pytest
from corpusloom import storage


def test_stored_tables_are_deleted(spark):
    df = storage.stored(spark.range(10).toDF("n"), "numbers")
    assert df.count() == 10 and df.schema.names == ["n"]
    folder = storage.tables_dir(spark).removeprefix("file:")
    assert os.path.isdir(folder)
    storage.clear_stored(spark)
    assert not os.path.isdir(folder)


def test_small_scans_use_all_cores(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    held = storage.scan(spark, str(tmp_path / "t"))
    assert held.count() == 1000 and held.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_a_cluster_needs_a_shared_folder(spark):
    class Elsewhere:
        """A session of a cluster without the setting."""

        def __init__(self, own):
            self.conf, self.own = own.conf, own

        @property
        def sparkContext(self):  # noqa: N802
            class Context:
                master = "spark://host:7077"

                class _jsc:  # noqa: N801
                    @staticmethod
                    def sc():
                        class Sc:
                            @staticmethod
                            def getCheckpointDir():  # noqa: N802
                                class Nothing:
                                    @staticmethod
                                    def isDefined():  # noqa: N802
                                        return False

                                return Nothing()

                        return Sc()

            return Context

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            storage.shared_dir(Elsewhere(spark))


def test_scratch_tables_go_with_their_block(spark):
    import os

    with storage.scratch(spark):
        inner = storage.stored(spark.range(3).toDF("n"), "inner")
        folder = storage.tables_dir(spark)
        with storage.scratch(spark):
            assert storage.tables_dir(spark).startswith(folder + "/")
        assert inner.count() == 3 and os.path.isdir(folder.removeprefix("file:"))
    assert not os.path.exists(folder.removeprefix("file:")) and storage.tables_dir(spark) != folder
