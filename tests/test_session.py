import os

import pytest

from stratiform import session


@pytest.mark.parametrize(
    "size, memory, executors",
    [(1 << 20, "4g", 2), (1 << 30, "8g", 2), (20 << 30, "16g", 2), (40 << 30, "16g", 4), (100 << 40, "16g", 1024)],
)
def test_sizing(size, memory, executors):
    settings = session.settings_for(size)
    assert settings["spark.driver.memory"] == memory
    assert settings["spark.executor.instances"] == str(executors)
    assert int(settings["spark.sql.shuffle.partitions"]) * session.TASK_BYTES >= size


def test_shared_folder_is_the_one_the_session_names(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert session.shared_dir(spark) == named
    folders = {session.new_folder(spark, "x") for _ in range(5)}
    assert len(folders) == 5 and all(os.path.dirname(os.path.dirname(f)) == named for f in folders)


def test_a_cluster_must_name_its_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
