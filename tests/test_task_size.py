import pytest
from prevalo.catalogue.claims_views import claims_from_star
from prevalo.sources import bounded_tasks
from prevalo.sources.staging import ADVISORY, INPUT_BYTES, PARTITIONS, SPLIT_BYTES, SPLITS, TASK_BYTES


@pytest.mark.parametrize(("own", "kept"), [("64MB", TASK_BYTES), ("20m", TASK_BYTES), ("16m", TASK_BYTES), ("8m", 8 << 20), ("16k", 16 << 10)])
def test_tasks_stop_growing(spark, own, kept):
    before = spark.conf.get(ADVISORY)
    try:
        spark.conf.set(ADVISORY, own)
        claims_from_star(spark, "/root/testdata/sf0.001")
        bytes_of = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
        assert bytes_of(spark.conf.get(ADVISORY)) == kept
        bounded_tasks(spark)
        assert bytes_of(spark.conf.get(ADVISORY)) == kept
    finally:
        spark.conf.set(ADVISORY, before)


@pytest.mark.parametrize(("own", "kept"), [(1, 5), (4, 5), (5, 5), (211, 211)])
def test_partitions_grow_with_the_input(spark, tmp_path, own, kept):
    """A file and a folder of files of 4.25 partitions' bytes together: few shuffle partitions become enough, many stay."""
    folder = tmp_path / "lines.parquet"
    folder.mkdir()
    for i in range(4):
        (folder / f"part-{i}").write_bytes(bytes(INPUT_BYTES))
    (tmp_path / "one.parquet").write_bytes(bytes(INPUT_BYTES // 4))
    before = spark.conf.get(PARTITIONS), spark.conf.get(ADVISORY)
    try:
        spark.conf.set(PARTITIONS, own)
        bounded_tasks(spark, str(folder), str(tmp_path / "one.parquet"))
        assert int(spark.conf.get(PARTITIONS)) == kept
    finally:
        spark.conf.set(PARTITIONS, before[0])
        spark.conf.set(ADVISORY, before[1])


def test_claims_raise_the_partitions(spark):
    before = spark.conf.get(PARTITIONS), spark.conf.get(ADVISORY)
    try:
        spark.conf.set(PARTITIONS, 1)
        claims_from_star(spark, "/root/testdata/sf0.1")
        assert int(spark.conf.get(PARTITIONS)) == 4  # 13.9 MB in four tables
    finally:
        spark.conf.set(PARTITIONS, before[0])
        spark.conf.set(ADVISORY, before[1])


@pytest.mark.parametrize(("own", "kept"), [("128MB", SPLIT_BYTES), ("16m", 16 << 20), ("64k", 64 << 10)])
def test_splits_stop_growing(spark, own, kept):
    before = spark.conf.get(SPLITS), spark.conf.get(ADVISORY)
    try:
        spark.conf.set(SPLITS, own)
        bounded_tasks(spark)
        assert spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(SPLITS)) == kept
    finally:
        spark.conf.set(SPLITS, before[0])
        spark.conf.set(ADVISORY, before[1])
