"""Logs derived from the sample tables."""

import os

import pytest

from turnledger.catalog.logs import overwrite_logs, write_running_total_logs
from turnledger.session import configure

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture
def small_partitions(spark):
    """Shuffles are coalesced to partitions of a few rows, as those of large tables to many."""
    settings = {
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


def _files(root):
    return {
        folder: [f for f in os.listdir(f"{root}/{folder}") if f.endswith(".txt") and not f.startswith(".")]
        for folder in os.listdir(root)
        if folder.startswith("conv_id=")
    }


def test_a_conversation_has_one_file_with_its_session_line(spark, small_partitions):
    (root,) = write_running_total_logs(spark, SF_DIR).roots
    files = _files(root)
    assert files and all(len(own) == 1 for own in files.values())
    for folder, (own,) in files.items():
        with open(f"{root}/{folder}/{own}") as log:
            lines = log.read().splitlines()
        named = [i for i, line in enumerate(lines) if '"session_meta"' in line]
        assert named == [0 if int(folder.split("=")[1]) % 2 == 0 else len(lines) - 1]


def test_overwritten_logs_keep_their_places(spark):
    old = write_running_total_logs(spark, SF_DIR, "turn < 1")
    before = _files(old.roots[0])
    overwrite_logs(spark, old, write_running_total_logs(spark, SF_DIR))
    (whole,) = write_running_total_logs(spark, SF_DIR).roots
    after = _files(old.roots[0])
    assert set(before) <= set(after) == set(_files(whole))
    for folder, (own,) in after.items():
        with open(f"{old.roots[0]}/{folder}/{own}") as log, open(f"{whole}/{folder}/{own}") as new:
            assert log.read() == new.read()


def test_folders_are_not_listed_one_by_one(spark):
    tasks = configure(spark).conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    assert int(tasks) <= 8 * spark.sparkContext.defaultParallelism
