"""Cohorts over arriving files: any division into files, batches and runs gives the cohort of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from prevalo import operators as op
from prevalo.streaming import compact_first_years, first_years, update_first_years
from tests.conftest import AMB, KH, rows


@pytest.fixture(scope="module")
def data():
    draw = random.Random(6)

    def entry():
        return 1 if draw.random() < 1 / 3 else draw.randint(2, 30), 1, draw.randint(2000, 2008)

    amb = [(*entry(), draw.choice(["A1", "A2", "B"]), draw.choice("GV")) for _ in range(300)]
    kh = [(*entry(), draw.choice(["A1", "B", "C"]), None) for _ in range(150)]
    return amb, kh


def arrive(spark, folder, table, some, files):
    schema = AMB if table == "AMBDIAG" else KH
    spark.createDataFrame(some, schema).repartition(files).write.mode("append").parquet(f"{folder}/{table}")


@pytest.mark.parametrize(("runs", "files_per_batch"), [(1, 100), (3, 1), (2, 2)])
def test_any_division_gives_the_batch_result(spark, claims, data, tmp_path, runs, files_per_batch):
    amb, kh = data
    folder, batches = str(tmp_path), 0
    sources = {t: f"{folder}/{t}" for t in ("AMBDIAG", "KHDIAG")}
    for i in range(runs):
        arrive(spark, folder, "AMBDIAG", amb[i::runs], 2)
        arrive(spark, folder, "KHDIAG", kh[i::runs], 2)
        batches += update_first_years(spark, sources, f"{folder}/log", f"{folder}/state", codes="A", exact=False, files_per_batch=files_per_batch)
        c = claims(amb=[r for k in range(i + 1) for r in amb[k::runs]], kh=[r for k in range(i + 1) for r in kh[k::runs]])
        assert rows(first_years(spark, f"{folder}/log")) == rows(op.cohort(c.diagnoses, "A", exact=False))
    assert batches >= runs
    # Nothing new: no batch, the same cohort. A repeated batch overwrites itself.
    assert update_first_years(spark, sources, f"{folder}/log", f"{folder}/state", codes="A", exact=False) == 0
    compact_first_years(spark, f"{folder}/log", f"{folder}/compact")
    assert rows(spark.read.parquet(f"{folder}/compact")) == rows(first_years(spark, f"{folder}/log"))


def test_a_run_that_fails_is_taken_up(spark, claims, data, tmp_path):
    """A batch that can't be written is repeated by the next run with the same files; earlier ones are not read again."""
    amb, _ = data
    folder = str(tmp_path)

    def run(log):
        return update_first_years(spark, {"AMBDIAG": f"{folder}/AMBDIAG"}, log, f"{folder}/state", files_per_batch=1)

    arrive(spark, folder, "AMBDIAG", amb[0::3], 1)
    assert run(f"{folder}/log") == 1
    for i in (1, 2):
        arrive(spark, folder, "AMBDIAG", amb[i::3], 1)
    tmp_path.joinpath("blocked").touch()
    with pytest.raises(Exception, match="STREAM_FAILED|FOREACH_BATCH"):
        run(f"{folder}/blocked/log")
    assert run(f"{folder}/log") == 2
    assert rows(first_years(spark, f"{folder}/log")) == rows(op.cohort(claims(amb=amb).diagnoses, ["A1", "A2", "B"]))


def test_logs_of_several_sources_are_one_cohort(spark, data, tmp_path):
    amb, kh = data
    arrive(spark, str(tmp_path), "AMBDIAG", amb, 1)
    for name, some in (("one", amb[:100]), ("two", amb[100:])):
        arrive(spark, f"{tmp_path}/{name}", "AMBDIAG", some, 1)
        update_first_years(spark, {"AMBDIAG": f"{tmp_path}/{name}/AMBDIAG"}, f"{tmp_path}/{name}/log", f"{tmp_path}/{name}/state", confirmed_only=False)
    both = first_years(spark, f"{tmp_path}/one/log", f"{tmp_path}/two/log")
    want = spark.createDataFrame(amb, AMB).groupBy("PSID", F.col("ICDAMB_CODE").alias("ICD_CODE")).agg(F.min("BJAHR"))
    assert rows(both) == rows(want)
