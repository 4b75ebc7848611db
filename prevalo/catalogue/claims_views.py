"""Claims-shaped tables derived from the star schema, for checks and benchmarks.

Orders become contacts of a person, line items their diagnoses; the open lines are
outpatient, the finished ones inpatient.
"""

from pyspark.sql import DataFrame, SparkSession
from prevalo.constants import INPATIENT, OUTPATIENT
from prevalo.sources import Claims, bounded_tasks

# The 50 codes that part sizes 1 to 50 stand for.
CODES = (
    "Q780,Q783,E849,I1090,S0220,S1200,S2230,S3200,S4220,S5250,S6260,S7200,S8210,S9230,"
    "T02,T08,T10,T12,M5450,I1000,I1500,R522,M2550,M7960,M7980,M7990,O30,R53,F480,T733,"
    "O80,O81,O82,UUU,R530,E8490,C222,C728,C812,C817,E780,J069,H522,Z129,E039,F329,K210,"
    "N390,B99,Z251"
)


def claims_from_star(spark: SparkSession, sf_dir: str) -> Claims:
    """AMBDIAG, KHDIAG, VERS and VERSQ as lazy frames over the parquet tables.

    Diagnoses come from one pass over the lines. The master tables only ask whether a
    contact has any line, so they semi-join the contacts instead of multiplying them.
    """

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    contacts = table("orders").selectExpr(
        "o_orderkey AS l_orderkey",
        "o_custkey AS PSID",
        "o_custkey * 10 + IF(o_orderdate < TIMESTAMP '1998-07-01 00:00:00', 1, 2) AS VSID",
        "year(o_orderdate) AS BJAHR",
        "quarter(o_orderdate) AS Q",
    )
    lines, parts = table("lineitem"), table("part").selectExpr("p_partkey AS l_partkey", "p_size")
    diagnoses = (
        lines.join(parts, "l_partkey")  # first, as a filter on the code is a filter on the parts
        .join(contacts, "l_orderkey")
        .selectExpr(
            "PSID",
            "VSID",
            "BJAHR",
            f"split_part('{CODES}', ',', p_size) AS ICD_CODE",
            f"IF(l_linestatus = 'F' AND l_linenumber % 3 = 0, split_part('{CODES}', ',', p_size * 3 % 50 + 1), NULL)"
            " AS SEK_CODE",
            "IF(l_linestatus = 'O', IF(l_returnflag IN ('A', 'R'), 'G', 'V'), NULL) AS DIAGSICH",
            f"CASE l_linestatus WHEN 'O' THEN '{OUTPATIENT}' WHEN 'F' THEN '{INPATIENT}' END AS SRC",
        )
    )
    ambdiag = diagnoses.filter(f"SRC = '{OUTPATIENT}'").selectExpr(
        "PSID", "VSID", "BJAHR", "ICD_CODE AS ICDAMB_CODE", "DIAGSICH"
    )
    khdiag = diagnoses.filter(f"SRC = '{INPATIENT}'").selectExpr(
        "PSID", "VSID", "BJAHR", "ICD_CODE AS ICDKH_CODE", "SEK_CODE AS SEKICD_CODE"
    )

    # Distinct first: a contact with very many lines is one row when it meets its semi-join.
    known = lines.join(parts, "l_partkey", "left_semi").select("l_orderkey").distinct()
    used = contacts.join(known, "l_orderkey", "left_semi")
    vers = (
        used.select("PSID", "VSID", "BJAHR")
        .distinct()
        .join(table("customer").selectExpr("c_custkey AS PSID", "c_nationkey"), "PSID")
        .selectExpr(
            "PSID",
            "VSID",
            "BJAHR",
            "CAST(IF(PSID % 41 = 0, NULL, 1910 + PSID * 13 % 85 + BJAHR % 2) AS INT) AS GEBJAHR",
            "CASE WHEN PSID % 31 = 0 THEN NULL WHEN PSID % 29 = 0 THEN ''"
            " ELSE lpad(CAST((c_nationkey * 4001 + PSID % 97 * 11) % 100000 AS STRING), 5, '0') END AS PLZ",
        )
    )
    versq = (
        used.select("PSID", "VSID", "BJAHR", "Q")
        .distinct()
        .selectExpr(
            "PSID",
            "VSID",
            "BJAHR * 10 + Q AS VERSQ",
            "CAST(CASE WHEN PSID % 23 = 0 THEN IF(BJAHR % 2 = 0, 1, 2) WHEN PSID % 19 = 0 THEN 0"
            " WHEN PSID % 17 = 0 THEN NULL ELSE 1 + PSID % 2 END AS INT) AS GESCHLECHT",
        )
    )
    bounded_tasks(spark, *(f"{sf_dir}/{name}.parquet" for name in ("customer", "part", "orders", "lineitem")))
    return Claims(ambdiag=ambdiag, khdiag=khdiag, vers=vers, versq=versq)


# The same tables as SQL common table expressions for the check engine.
CLAIMS_SQL = f"""
CLAIM AS (
  SELECT o.o_custkey AS PSID,
    o.o_custkey * 10 + CASE WHEN o.o_orderdate < TIMESTAMP '1998-07-01 00:00:00' THEN 1 ELSE 2 END AS VSID,
    CAST(year(o.o_orderdate) AS INT) AS BJAHR, CAST(quarter(o.o_orderdate) AS INT) AS Q,
    split_part('{CODES}', ',', p.p_size) AS ICD,
    CASE WHEN l.l_linenumber % 3 = 0 THEN split_part('{CODES}', ',', (p.p_size * 3) % 50 + 1) END AS SEK,
    CASE WHEN l.l_returnflag IN ('A', 'R') THEN 'G' ELSE 'V' END AS DIAGSICH, l.l_linestatus AS SRC
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey),
AMBDIAG AS (SELECT PSID, VSID, BJAHR, ICD AS ICDAMB_CODE, DIAGSICH FROM CLAIM WHERE SRC = 'O'),
KHDIAG AS (SELECT PSID, VSID, BJAHR, ICD AS ICDKH_CODE, SEK AS SEKICD_CODE FROM CLAIM WHERE SRC = 'F'),
VERS AS (
  SELECT DISTINCT c.PSID, c.VSID, c.BJAHR,
    CAST(CASE WHEN c.PSID % 41 = 0 THEN NULL ELSE 1910 + (c.PSID * 13) % 85 + c.BJAHR % 2 END AS INT) AS GEBJAHR,
    CASE WHEN c.PSID % 31 = 0 THEN NULL WHEN c.PSID % 29 = 0 THEN ''
         ELSE lpad(CAST((k.c_nationkey * 4001 + (c.PSID % 97) * 11) % 100000 AS VARCHAR(10)), 5, '0') END AS PLZ
  FROM CLAIM c JOIN customer k ON c.PSID = k.c_custkey),
VERSQ AS (
  SELECT DISTINCT PSID, VSID, BJAHR * 10 + Q AS VERSQ,
    CAST(CASE WHEN PSID % 23 = 0 THEN CASE WHEN BJAHR % 2 = 0 THEN 1 ELSE 2 END
              WHEN PSID % 19 = 0 THEN 0 WHEN PSID % 17 = 0 THEN NULL ELSE 1 + PSID % 2 END AS INT) AS GESCHLECHT
  FROM CLAIM)"""
