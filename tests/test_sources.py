from pathlib import Path
from types import SimpleNamespace

import pyarrow.parquet as pq
import pytest
from pyspark.errors import AnalysisException

from prevalo import sources
from prevalo.sources.staging import staging_root
from tests.conftest import rows

CSV = {
    "AMBDIAG": "PSID,EXTRA,VSID,BJAHR,DIAGSICH,ICDAMB_CODE\n1,x,10,2015,G,Q780\n2,y,20,2016,NA,\n",
    "KHDIAG": "PSID,VSID,BJAHR,ICDKH_CODE,SEKICD_CODE\n1,10,2015,S720,NA\n",
    "VERS": "PSID,VSID,GEBJAHR,PLZ\n1,10,1990,01067\n2,20,NA,\n",
    "VERSQ": "PSID,VSID,VERSQ,GESCHLECHT\n1,10,20151,1\n",
}


@pytest.fixture
def folder(tmp_path):
    for table, text in CSV.items():
        (tmp_path / f"{table}.csv").write_text(text)
    return tmp_path


def test_csv_columns_are_taken_by_name_and_typed(spark, folder):
    c = sources.read_claims(spark, str(folder))
    assert rows(c.ambdiag) == [(1, 10, 2015, "Q780", "G"), (2, 20, 2016, None, None)]
    assert rows(c.vers) == [(1, 10, 1990, "01067"), (2, 20, None, None)]
    assert rows(c.diagnoses, "PSID", "ICD_CODE", "SRC") == [(1, "Q780", "AMB"), (1, "S720", "KH"), (2, None, "AMB")]


def test_text_person_ids(spark, folder):
    from pyspark.sql.types import StringType

    assert dict(sources.read_claims(spark, str(folder), id_type=StringType()).vers.dtypes)["PSID"] == "string"


def test_absent_table_is_an_error_or_a_warning(spark, tmp_path):
    for table in ("AMBDIAG", "VERS", "VERSQ"):
        (tmp_path / f"{table}.csv").write_text(CSV[table])
    with pytest.warns(UserWarning, match="KHDIAG"):
        c = sources.read_claims(spark, str(tmp_path))
    assert c.khdiag is None and c.diagnoses.count() == 2
    with pytest.raises(AnalysisException):
        sources.read_claims(spark, str(tmp_path), optional=())


def test_missing_column_is_named(spark, folder):
    (folder / "VERS.csv").write_text("PSID,VSID,PLZ\n1,1,01067\n")
    with pytest.raises(ValueError, match="GEBJAHR"):
        sources.read_claims(spark, str(folder))


def test_stored_claims_read_back(spark, folder, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("stored"))
    given = sources.read_claims(spark, str(folder))
    stored = sources.store_claims(given, root)
    again = sources.read_claims(spark, root, "parquet")
    for name in ("ambdiag", "khdiag", "vers", "versq"):
        assert rows(getattr(stored, name)) == rows(getattr(again, name)) == rows(getattr(given, name))


def test_stored_diagnoses_are_ordered_by_code_within_files(spark, claims, tmp_path):
    c = claims(amb=[(p, 1, 2015, f"{chr(90 - p % 26)}00", "G") for p in range(200)])
    sources.store_claims(c, str(tmp_path))
    for part in (tmp_path / "AMBDIAG.parquet").glob("*.parquet"):
        codes = pq.read_table(part).column("ICDAMB_CODE").to_pylist()
        assert codes == sorted(codes)


def test_views_and_catalogue_tables(spark, folder):
    c = sources.read_claims(spark, str(folder))
    c.register_views()
    assert spark.sql("SELECT count(*) FROM AMBDIAG").first()[0] == 2
    spark.sql("CREATE DATABASE IF NOT EXISTS study")
    for name in ("ambdiag", "khdiag", "vers", "versq"):
        getattr(c, name).write.mode("overwrite").saveAsTable(f"study.DATRAV_{name.upper()}")
    assert rows(sources.read_claims_tables(spark, "study").vers) == rows(c.vers)


def write_list(path, codes, eol="\r\n", bom="﻿", before=()):
    header = "CODE;TEXT;ORPHA;ORPHA_TEXT;LEVEL"
    body = [f"{c};Text, {c};{n};Name [x];  Disorder" for n, c in enumerate(codes)]
    path.write_bytes((bom + eol.join([*before, header, *body]) + eol).encode())


def test_code_list_with_mark_and_windows_line_ends(spark, tmp_path):
    codes = [f"{chr(65 + n // 100)}{n % 100:02d}.{n % 10}" for n in range(239)]
    write_list(tmp_path / "list.csv", codes)
    found = sources.read_code_list(spark, str(tmp_path / "list.csv"))
    assert found.count() == 239
    first = found.first()
    assert tuple(first) == ("A000", "Text, A00.0", "0", "Name [x]", "Disorder")
    assert {r.ICD_CODE for r in found.collect()} == {c.replace(".", "") for c in codes}
    # Skipping a line too many takes the first code for the header.
    assert sources.read_code_list(spark, str(tmp_path / "list.csv"), skip_rows=1).count() == 238


def test_code_list_with_metadata_line(spark, tmp_path):
    write_list(tmp_path / "list.csv", ["D51.1", "G36"], eol="\n", bom="", before=["version 3"])
    found = sources.read_code_list(spark, str(tmp_path / "list.csv"), skip_rows=1)
    assert rows(found, "ICD_CODE") == [("D511",), ("G36",)]


def test_absent_code_list_is_an_error(spark, tmp_path):
    with pytest.raises(AnalysisException):
        sources.read_code_list(spark, str(tmp_path / "none.csv")).count()


def test_code_frame_keeps_order(spark):
    assert rows(sources.code_frame(spark, ["Q78.0", "A00"])) == [(0, "Q780"), (1, "A00")]


def test_results_replace_each_other(spark, tmp_path):
    path = str(tmp_path / "RT")
    sources.write_result(spark.range(3), path)
    sources.write_result(spark.range(2), path)
    assert spark.read.parquet(path).count() == 2


def test_csv_results_are_sorted_with_a_header(spark, tmp_path):
    df = spark.createDataFrame([("b", 1), ("a", 2)], "code string, n long")
    sources.write_result(df, str(tmp_path / "RT"), "csv", order_by=["code"], single_file=True)
    (part,) = (tmp_path / "RT").glob("*.csv")
    assert part.read_text() == "code,n\na,2\nb,1\n"


def test_staging_uses_the_folder_of_the_session(spark):
    assert staging_root(spark) == spark.conf.get("spark.checkpoint.dir")
    staged = sources.stage(spark.range(5).toDF("PSID"), "five")
    assert staged.count() == 5
    assert all(staging_root(spark) in f for f in staged.inputFiles())


def test_staged_tables_can_be_cleared(spark):
    staged = sources.stage(spark.range(5).toDF("PSID"), "five")
    (folder,) = {Path(f.removeprefix("file://")).parent for f in staged.inputFiles()}
    assert folder.exists()
    sources.clear_staged(spark)
    assert not folder.exists()
    assert sources.stage(spark.range(3), "three").count() == 3


def cluster(**settings):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: settings.get(key.rsplit(".", 1)[1], default)),
        sparkContext=SimpleNamespace(master="yarn", getCheckpointDir=lambda: None),
    )


def test_staging_needs_a_shared_folder_outside_local_mode():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging_root(cluster())
    with pytest.raises(RuntimeError, match="can't share"):
        staging_root(cluster(dir="file:///tmp/x"))
    assert staging_root(cluster(dir="file:///mnt/x", sharedFiles="true")) == "file:///mnt/x"
    assert staging_root(cluster(dir="hdfs://a/b")) == "hdfs://a/b"


def test_scopes_are_cleared_alone(spark):
    outside = sources.stage(spark.range(5).toDF("PSID"), "five")
    with sources.staging_scope(spark) as folder:
        inside = sources.stage(spark.range(4).toDF("PSID"), "four", bucket_by=["PSID"])
        sources.stage(spark.range(3), "three")
    assert inside.count() == 4 and Path(folder.removeprefix("file://")).exists()
    sources.clear_staged(spark, folder)
    assert not Path(folder.removeprefix("file://")).exists() and outside.count() == 5


def test_quoted_fields_of_a_code_list(spark, tmp_path):
    (tmp_path / "list.csv").write_text('CODE;TEXT;O;T;L\nA00.0;"first\nx;y ""z""";1;n;l\nB01;plain;2;n;l\n')
    found = sources.read_code_list(spark, str(tmp_path / "list.csv")).collect()
    assert [(r[0], r[1], r[2]) for r in found] == [("A000", 'first\nx;y "z"', "1"), ("B01", "plain", "2")]
