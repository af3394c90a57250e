"""Intermediate tables: where they may be, and when they go."""

import os

import pytest

from foliary.llm import scratch


def test_tables_go_when_asked(spark):
    own = scratch.Scratch(spark, "t")
    table = own.save(spark.range(3), "a")
    folder = own.root.removeprefix("file://")
    assert table.count() == 3 and os.path.isdir(f"{folder}/a")
    scratch.clear()
    assert not os.path.isdir(folder) and scratch.Scratch.live == []


def test_a_cluster_needs_a_shared_folder():
    class Spark:
        class conf:
            get = staticmethod(lambda key, default: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="share"):
        scratch.shared_dir(Spark)
