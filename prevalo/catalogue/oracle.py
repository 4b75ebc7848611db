"""Check SQL for every registered query, over the same star-schema tables.

Written from the definitions of the results, not from the Spark plans: distinct counts
stay distinct counts, first rows come from windows and each diagnosis source is read in
its own branch.
"""

from prevalo.catalogue.claims_views import CLAIMS_SQL

YEAR = 2002

# Fixed values, written out here once more so that a slip in the library can't hide in its check.
BANDS_ADULT = ((0, 17, "0-17"), (18, 59, "18-59"), (60, None, "60+"))
BANDS_EVENT = ((0, 18, "0-18"), (19, 49, "19-49"), (50, None, "50+"))
BANDS_FOUR = ((0, 19, "0-19"), (20, 39, "20-39"), (40, 59, "40-59"), (60, None, "60+"))
BANDS_EIGHT = (
    (None, 17, "0-17"), (18, 29, "18-29"), (30, 39, "30-39"), (40, 49, "40-49"), (50, 59, "50-59"),
    (60, 69, "60-69"), (70, 79, "70-79"), (80, None, "80+"),
)
TRACKED_EXACT = ("R53", "F480", "T733", "O80", "O81", "O82")
TRACKED_EXACT_SHORT = ("R53", "F480", "T733")
TRACKED_CODES_SHORT = (
    "S02", "S12", "S22", "S32", "S42", "S52", "S62", "S72", "S82", "S92", "T02", "T08",
    "T10", "T12", "M54", "I10", "I15", "R52", "M25", "M796", "M798", "M799",
)
TRACKED_CODES = (*TRACKED_CODES_SHORT, "O30")
LISTED_CODES = ("Q780", "E849", "S7200", "I1000", "R53", "N390", "B99", "A000", "Z999")
PREFIXES = ("Q78", "R53", "R530", "S", "E8490", "X1")
DICTIONARY_TABLES = (
    ("RT_AGE_SEX_DIST", "Alters- und Geschlechtsverteilung für ICD-10: "),
    ("RT_COMORBIDITIES", "Top 20 Komorbiditäten (≥10% Prävalenz) für ICD-10: "),
)
DICTIONARY_SUBJECT, FREQUENCY_TABLE = "Versichertenbezug", "Häufigkeitstabelle"
INCLUSION_TEXT = "Versicherte mit ambulanter Diagnose(n): "


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _band(age: str, bands, otherwise: str = "NULL") -> str:
    whens = []
    for low, high, label in bands:
        tests = [f"{age} >= {low}"] * (low is not None) + [f"{age} <= {high}"] * (high is not None)
        whens.append(f"WHEN {' AND '.join(tests)} THEN '{label}'")
    return f"CASE {' '.join(whens)} ELSE {otherwise} END"


def _starts(column: str, prefixes) -> list[str]:
    return [f"starts_with({column}, '{p}')" for p in prefixes]


def _sex(column: str, otherwise: str = "'Unknown'") -> str:
    return f"CASE {column} WHEN 1 THEN 'Female' WHEN 2 THEN 'Male' ELSE {otherwise} END"


# --- building blocks: one common table expression each --------------------------------------

SHARED = {
    "CASES": """
      SELECT PSID, VSID, ICD_CODE, min(BJAHR) AS BJAHR FROM (
        SELECT PSID, VSID, ICDAMB_CODE AS ICD_CODE, BJAHR FROM AMBDIAG
        WHERE ICDAMB_CODE = 'Q780' AND DIAGSICH = 'G'
        UNION ALL
        SELECT PSID, VSID, ICDKH_CODE, BJAHR FROM KHDIAG WHERE 'Q780' IN (ICDKH_CODE, SEKICD_CODE)
      ) GROUP BY ALL""",
    "REST": """
      SELECT PSID, VSID, ICD_CODE, min(BJAHR) AS BJAHR FROM (
        SELECT PSID, VSID, ICDAMB_CODE AS ICD_CODE, BJAHR FROM AMBDIAG WHERE DIAGSICH = 'G'
        UNION ALL
        SELECT PSID, VSID, ICDKH_CODE, BJAHR FROM KHDIAG)
      WHERE PSID NOT IN (SELECT PSID FROM CASES)
      GROUP BY ALL""",
    "HOMES": "SELECT PSID, VSID, min(GEBJAHR) AS GEBJAHR, min(PLZ) AS PLZ FROM VERS GROUP BY PSID, VSID",
    "AGREED": f"""
      SELECT PSID, VSID,
        CASE WHEN count(DISTINCT GESCHLECHT) FILTER (GESCHLECHT IN (1, 2)) = 1
             THEN {_sex("min(GESCHLECHT) FILTER (GESCHLECHT IN (1, 2))")}
             ELSE 'Unknown' END AS GESCHLECHT_LABEL
      FROM VERSQ GROUP BY PSID, VSID""",
    "CASE_YEARS": """
      SELECT PSID, VSID, BJAHR FROM AMBDIAG WHERE ICDAMB_CODE = 'Q780' AND DIAGSICH = 'G'
      UNION
      SELECT PSID, VSID, BJAHR FROM KHDIAG WHERE 'Q780' IN (ICDKH_CODE, SEKICD_CODE)""",
    "DEMO_CASES": f"""
      SELECT i.PSID, i.ICD_CODE, i.BJAHR, h.PLZ, i.BJAHR - h.GEBJAHR AS ALTER,
        {_band("(i.BJAHR - h.GEBJAHR)", BANDS_EVENT, "'Unknown'")} AS AGE_GROUP, s.GESCHLECHT_LABEL
      FROM CASES i JOIN HOMES h USING (PSID, VSID) JOIN AGREED s USING (PSID, VSID)
      WHERE s.GESCHLECHT_LABEL <> 'Unknown'""",
    "DEMO_REST": f"""
      SELECT i.PSID, i.ICD_CODE, i.BJAHR, h.PLZ, i.BJAHR - h.GEBJAHR AS ALTER,
        {_band("(i.BJAHR - h.GEBJAHR)", BANDS_EVENT)} AS AGE_GROUP,
        nullif(s.GESCHLECHT_LABEL, 'Unknown') AS GESCHLECHT_LABEL
      FROM REST i JOIN HOMES h USING (PSID, VSID) LEFT JOIN AGREED s USING (PSID, VSID)""",
    "PERSONS": "SELECT PSID, min(GEBJAHR) AS GEBJAHR, min(PLZ) AS PLZ FROM VERS GROUP BY PSID",
    "FIRST_SEX": """
      SELECT PSID, GESCHLECHT FROM VERSQ
      QUALIFY row_number() OVER (PARTITION BY PSID
        ORDER BY VERSQ NULLS FIRST, VSID NULLS FIRST, GESCHLECHT NULLS FIRST) = 1""",
    "RARE": """
      SELECT PSID, ICD_CODE, min(BJAHR) AS BJAHR FROM (
        SELECT PSID, ICDAMB_CODE AS ICD_CODE, BJAHR FROM AMBDIAG WHERE ICDAMB_CODE = 'Q780' AND DIAGSICH = 'G'
        UNION ALL
        SELECT PSID, ICDKH_CODE, BJAHR FROM KHDIAG WHERE ICDKH_CODE = 'Q780')
      GROUP BY ALL""",
    "LISTED_COHORTS": f"""
      SELECT PSID, ICD_CODE, min(BJAHR) AS BJAHR FROM (
        SELECT PSID, ICDAMB_CODE AS ICD_CODE, BJAHR FROM AMBDIAG WHERE DIAGSICH = 'G'
        UNION ALL
        SELECT PSID, ICDKH_CODE, BJAHR FROM KHDIAG)
      WHERE ICD_CODE IN ({_quoted(LISTED_CODES)})
      GROUP BY ALL""",
    "TWO_CASES": """
      SELECT PSID, VSID, ICD_CODE, min(BJAHR) AS BJAHR FROM (
        SELECT PSID, VSID, ICDAMB_CODE AS ICD_CODE, BJAHR FROM AMBDIAG
        WHERE ICDAMB_CODE IN ('Q780', 'Q783') AND DIAGSICH = 'G'
        UNION ALL
        SELECT PSID, VSID, ICDKH_CODE, BJAHR FROM KHDIAG
        WHERE ICDKH_CODE IN ('Q780', 'Q783') OR SEKICD_CODE IN ('Q780', 'Q783')
      ) GROUP BY ALL""",
    "TWO_REST": """
      SELECT PSID, VSID, BJAHR FROM (
        SELECT PSID, VSID, ICD_CODE, min(BJAHR) AS BJAHR FROM (
          SELECT PSID, VSID, ICDAMB_CODE AS ICD_CODE, BJAHR FROM AMBDIAG WHERE DIAGSICH = 'G'
          UNION ALL
          SELECT PSID, VSID, ICDKH_CODE, BJAHR FROM KHDIAG)
        WHERE PSID NOT IN (SELECT PSID FROM TWO_CASES)
        GROUP BY ALL)""",
    "LEGACY": """
      SELECT DISTINCT PSID, ICDAMB_CODE AS ICD_CODE, BJAHR FROM AMBDIAG WHERE ICDAMB_CODE = 'Q780'
      UNION ALL
      SELECT DISTINCT PSID, ICDKH_CODE, BJAHR FROM KHDIAG WHERE ICDKH_CODE = 'Q780'""",
    "LEGACY_REST": """
      SELECT PSID, ICD_CODE, BJAHR FROM (
        SELECT PSID, ICDAMB_CODE AS ICD_CODE, BJAHR FROM AMBDIAG
        UNION ALL
        SELECT PSID, ICDKH_CODE, BJAHR FROM KHDIAG)
      WHERE PSID NOT IN (SELECT PSID FROM LEGACY)""",
    "SEVERAL": """
      SELECT DISTINCT PSID, ICDAMB_CODE, BJAHR FROM AMBDIAG
      WHERE ICDAMB_CODE IN ('C222', 'C728', 'C812', 'C817')""",
    "SEVERAL_REST": """
      SELECT DISTINCT PSID, ICDAMB_CODE, BJAHR FROM AMBDIAG WHERE PSID NOT IN (SELECT PSID FROM SEVERAL)""",
    "DIAGNOSED": f"""
      SELECT a.PSID, f.GESCHLECHT, f.ALTER FROM AMBDIAG a JOIN FIRST_PAIR f USING (PSID)
      WHERE starts_with(a.ICDAMB_CODE, 'Q780')""",
    "FIRST_PAIR": f"""
      SELECT PSID, v.VSID AS VSID_X, v.GEBJAHR, v.PLZ, q.VSID AS VSID_Y, q.VERSQ,
        {_sex("q.GESCHLECHT", "NULL")} AS GESCHLECHT, {YEAR} - v.GEBJAHR AS ALTER
      FROM VERS v JOIN VERSQ q USING (PSID)
      QUALIFY row_number() OVER (PARTITION BY PSID ORDER BY
        q.VERSQ NULLS FIRST, q.VSID NULLS FIRST, q.GESCHLECHT NULLS FIRST,
        v.VSID NULLS FIRST, v.GEBJAHR NULLS FIRST, v.PLZ NULLS FIRST) = 1""",
    "ROW_COUNTS": """
      SELECT ICDAMB_CODE, count(*) AS n FROM AMBDIAG
      WHERE PSID IN (SELECT PSID FROM DIAGNOSED) AND ICDAMB_CODE NOT IN ('Q780', 'UUU')
      GROUP BY ICDAMB_CODE
      HAVING count(*) >= (SELECT count(DISTINCT PSID) FROM DIAGNOSED) * CAST(0.1 AS DOUBLE)""",
    "LABELS": """
      SELECT BJAHR AS year, ICDAMB_CODE AS icd_sub, 'Diagnose ' || ICDAMB_CODE || ' (' || BJAHR || ')' AS label
      FROM AMBDIAG GROUP BY ALL""",
    "LATEST_LABELS": """
      SELECT icd_sub AS ICDAMB_CODE, label FROM LABELS WHERE year IN (1999, 2000)
      QUALIFY row_number() OVER (PARTITION BY icd_sub ORDER BY year DESC) = 1""",
    "COMORBID": """
      SELECT s.ICDAMB_CODE AS ICDAMB_CODE_BASE, a.BJAHR, a.ICDAMB_CODE AS ICDAMB_CODE_COMORBID,
        count(DISTINCT a.PSID) AS CNT_D_PSID
      FROM AMBDIAG a JOIN SEVERAL s ON a.PSID = s.PSID AND a.BJAHR = s.BJAHR
      WHERE a.ICDAMB_CODE NOT IN ('C222', 'C728', 'C812', 'C817', 'UUU')
      GROUP BY ALL""",
    "COMORBID_TOP": """
      SELECT *, CAST(dense_rank() OVER (
          PARTITION BY ICDAMB_CODE_BASE, BJAHR ORDER BY CNT_D_PSID DESC) AS INT) AS RN
      FROM COMORBID
      WHERE CNT_D_PSID >= ceil((SELECT count(DISTINCT PSID) FROM SEVERAL) * CAST(0.01 AS DOUBLE))
      QUALIFY RN <= 20""",
    "AGE_SEX_EIGHT": f"""
      SELECT s.ICDAMB_CODE, s.BJAHR, {_band(f"({YEAR} - p.GEBJAHR)", BANDS_EIGHT, "'Unknown'")} AS ALTERSGRUPPE,
        {_sex("f.GESCHLECHT")} AS GESCHLECHT_LABEL, count(s.PSID) AS CNT_D_PSID
      FROM SEVERAL s JOIN PERSONS p USING (PSID) JOIN FIRST_SEX f USING (PSID)
      GROUP BY ALL""",
    "AGE_SEX_REST": f"""
      SELECT r.ICDAMB_CODE, r.BJAHR, {_band(f"({YEAR} - v.GEBJAHR)", BANDS_EIGHT)} AS ALTERSGRUPPE,
        {_sex("q.GESCHLECHT")} AS GESCHLECHT_LABEL, count(DISTINCT r.PSID) AS CNT_D_PSID
      FROM SEVERAL_REST r JOIN VERS v ON r.PSID = v.PSID JOIN VERSQ q ON r.PSID = q.PSID
      WHERE v.GEBJAHR IS NOT NULL AND q.GESCHLECHT IN (1, 2)
      GROUP BY ALL""",
    "CONFIRMED": """
      SELECT PSID, VSID, ICDAMB_CODE AS ICD_CODE, BJAHR FROM AMBDIAG WHERE DIAGSICH = 'G'
      UNION ALL SELECT PSID, VSID, ICDKH_CODE, BJAHR FROM KHDIAG""",
    "FIRST_YEARS": "SELECT PSID, ICD_CODE, min(BJAHR) AS BJAHR FROM CONFIRMED GROUP BY ALL",
    "EVENTS": "SELECT PSID, ICD_CODE, BJAHR, count(*) AS N_ROWS FROM CONFIRMED GROUP BY ALL",
    "QUARTERS": "SELECT DISTINCT PSID, VERSQ // 10 * 4 + VERSQ % 10 - 1 AS Q FROM VERSQ WHERE VERSQ % 10 BETWEEN 1 AND 4",
    "CASE_TYPES": """
      SELECT y.*, CASE WHEN YEARS_SINCE <= 1 THEN 'PREVALENT'
        WHEN (SELECT count(*) FROM QUARTERS q WHERE q.PSID = y.PSID AND q.Q BETWEEN y.BJAHR * 4 - 4 AND y.BJAHR * 4 - 1) < 4
        THEN 'UNOBSERVED' ELSE 'INCIDENT' END AS CASE_TYPE
      FROM (SELECT PSID, ICD_CODE, BJAHR, BJAHR - lag(BJAHR) OVER (PARTITION BY PSID, ICD_CODE ORDER BY BJAHR) AS YEARS_SINCE
            FROM EVENTS) y""",
}

# Which shared expressions each one needs, besides the claims tables.
NEEDS = {
    "EVENTS": ["CONFIRMED"],
    "FIRST_YEARS": ["CONFIRMED"],
    "CASE_TYPES": ["EVENTS", "QUARTERS"],
    "REST": ["CASES"],
    "DEMO_CASES": ["CASES", "HOMES", "AGREED"],
    "DEMO_REST": ["REST", "HOMES", "AGREED"],
    "LEGACY_REST": ["LEGACY"],
    "SEVERAL_REST": ["SEVERAL"],
    "DIAGNOSED": ["FIRST_PAIR"],
    "ROW_COUNTS": ["DIAGNOSED"],
    "LATEST_LABELS": ["LABELS"],
    "COMORBID": ["SEVERAL"],
    "COMORBID_TOP": ["COMORBID"],
    "AGE_SEX_EIGHT": ["SEVERAL", "PERSONS", "FIRST_SEX"],
    "AGE_SEX_REST": ["SEVERAL_REST"],
    "TWO_REST": ["TWO_CASES"],
}


def _fixed_year(members: str, bands) -> str:
    """Members with age in the fixed year and the first sex entry."""
    return f"""
      SELECT i.PSID, i.ICD_CODE, i.BJAHR, p.PLZ, {YEAR} - p.GEBJAHR AS ALTER,
        {_band(f"({YEAR} - p.GEBJAHR)", bands, "'Unknown'")} AS AGE_GROUP, {_sex("f.GESCHLECHT")} AS GESCHLECHT_LABEL
      FROM {members} i JOIN PERSONS p USING (PSID) JOIN FIRST_SEX f USING (PSID)"""


def _groups(column: str, tracked, exact, certainty: str = "", legacy: bool = False) -> list[tuple[str, str]]:
    """(group expression, condition) of the exact and the prefix branch of one source."""
    prefixes = [c for c in tracked if c not in exact]
    tests = " OR ".join(_starts(column, prefixes))
    return [
        (column, f"{column} IN ({_quoted(exact)}){certainty}"),
        (f"substring({column}, 1, 3)", f"{tests}{certainty}" if legacy else f"({tests}){certainty}"),
    ]


def _found(link: str, columns: str, tracked, exact, certainty: str, legacy: bool = False) -> str:
    branches = []
    for table, column, sure in (("AMBDIAG", "ICDAMB_CODE", certainty), ("KHDIAG", "ICDKH_CODE", "")):
        for group, condition in _groups(column, tracked, exact, sure, legacy):
            branches.append(
                f"SELECT {columns}, {column} AS ICD_CODE, {group} AS ICD_GROUP FROM {table} "
                f"WHERE {link} AND ({condition})"
            )
    return "\n UNION \n".join(branches)


def _occurrence_counts(found: str) -> str:
    band = _band("(o.BJAHR - h.GEBJAHR)", BANDS_EVENT)
    return f"""
      SELECT ICD_GROUP, GESCHLECHT_LABEL, AGE_GROUP, CAST(sum(n) AS BIGINT) AS CNT_D_PSID FROM (
        SELECT o.ICD_GROUP, o.BJAHR, s.GESCHLECHT_LABEL, {band} AS AGE_GROUP, count(DISTINCT o.PSID) AS n
        FROM ({found}) o JOIN HOMES h USING (PSID, VSID) JOIN AGREED s USING (PSID, VSID)
        WHERE s.GESCHLECHT_LABEL <> 'Unknown' AND {band} IS NOT NULL
        GROUP BY ALL)
      GROUP BY ALL"""


def _sex_share(measure: str) -> str:
    return f"""
      SELECT GESCHLECHT, n, percent,
        printf('%s' || chr(10) || '%d (%.1f%%)', coalesce(GESCHLECHT, 'NA'), n, percent) AS label
      FROM (SELECT GESCHLECHT, n, CAST(n AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE) * 100 AS percent
            FROM (SELECT GESCHLECHT, {measure} AS n FROM DIAGNOSED GROUP BY GESCHLECHT))"""


def _plz_case_control(area: str) -> str:
    def side(demo: str) -> str:
        return f"""SELECT {area} AS AREA, count(DISTINCT PSID) FILTER (GESCHLECHT_LABEL = 'Female') AS f,
                     count(DISTINCT PSID) FILTER (GESCHLECHT_LABEL = 'Male') AS m
                   FROM {demo} WHERE PLZ <> '' GROUP BY AREA"""

    return f"""
      SELECT AREA AS PLZ, coalesce(c.f, 0) + coalesce(c.m, 0) + coalesce(r.f, 0) + coalesce(r.m, 0) AS CNT_D_PSID_TOTAL,
        coalesce(c.f, 0) AS CNT_D_PSID_OI_F, coalesce(c.m, 0) AS CNT_D_PSID_OI_M,
        coalesce(r.f, 0) AS CNT_D_PSID_REMAIN_F, coalesce(r.m, 0) AS CNT_D_PSID_REMAIN_M
      FROM ({side("DEMO_CASES")}) c FULL JOIN ({side("DEMO_REST")}) r USING (AREA)"""


IN_ANY_CASE_YEAR = "(PSID, VSID, BJAHR) IN (SELECT (PSID, VSID, BJAHR) FROM CASE_YEARS)"
IN_CASE_YEAR = "(PSID, VSID, BJAHR) IN (SELECT (PSID, VSID, BJAHR) FROM CASES)"
LEGACY_FOUND = _found(
    "PSID IN (SELECT PSID FROM LEGACY)", "PSID, BJAHR", TRACKED_CODES_SHORT, TRACKED_EXACT_SHORT, ""
)
REST_FOUND = "\n UNION \n".join(
    f"SELECT PSID, VSID, BJAHR, {group} AS ICD_GROUP FROM REST WHERE {condition}"
    for group, condition in _groups("ICD_CODE", TRACKED_CODES, TRACKED_EXACT)
)

LISTED = """SELECT DISTINCT regexp_replace(ICD, '^(...)(.+)$', '\\1.\\2') AS LISTED_CODE FROM CLAIM"""

_QUARTER = "VERSQ // 10 * 4 + VERSQ % 10 - 1"


def _quarter_id(number: str) -> str:
    return f"CAST({number} // 4 * 10 + {number} % 4 + 1 AS INT)"


def _spells(key: str, quarters: str, gap: int) -> str:
    """Quarters with the number of their spell, which more than ``gap`` missing quarters end."""
    order = f"(PARTITION BY {key} ORDER BY Q)"
    return f"""SELECT {key}, Q, CAST(sum(NEW) OVER {order} AS INT) AS SPELL FROM (
                 SELECT *, CASE WHEN Q - lag(Q) OVER {order} <= {gap + 1} THEN 0 ELSE 1 END AS NEW FROM ({quarters}))"""


def _suppressed(table: str, rows: str, columns: str, layers: list[str], value: str, k: int) -> str:
    """Margins by grouping sets; for each small cell the cheapest of all rectangles with it as a corner."""
    layer = ", ".join(layers) + ", " if layers else ""
    where = " AND ".join(f"{{0}}.{c} = {{1}}.{c}" for c in layers) or "true"
    own = ", ".join(f"a.{c}" for c in [*layers, "R", "C"])
    corner = f"SELECT {layer}R, C FROM HIDDEN"
    return f"""
      WITH CELLS AS MATERIALIZED (
        SELECT {layer}(grouping({rows}), {rows}) AS R, (grouping({columns}), {columns}) AS C, CAST(sum({value}) AS BIGINT) AS N,
          grouping({rows}) + grouping({columns}) > 0 AS MARGIN
        FROM ({table}) GROUP BY GROUPING SETS (({layer}{rows}, {columns}), ({layer}{rows}), ({layer}{columns}), ({", ".join(layers)}))),
      PRICED AS MATERIALIZED (SELECT *, N BETWEEN 1 AND {k - 1} AS SMALL, CASE WHEN N BETWEEN 1 AND {k - 1} OR NOT MARGIN THEN 0 ELSE 1 END AS M,
        CASE WHEN N BETWEEN 1 AND {k - 1} THEN 0 ELSE N END AS V FROM CELLS),
      CHOSEN AS (
        SELECT {own}, d.R AS R2, d.C AS C2 FROM PRICED a
        JOIN PRICED b ON {where.format("a", "b")} AND a.R = b.R AND a.C <> b.C
        JOIN PRICED c ON {where.format("a", "c")} AND a.C = c.C AND a.R <> c.R
        JOIN PRICED d ON {where.format("a", "d")} AND d.R = c.R AND d.C = b.C
        WHERE a.SMALL AND b.N > 0 AND c.N > 0 AND d.N > 0
        QUALIFY row_number() OVER (PARTITION BY {own} ORDER BY b.M + c.M + d.M, b.V + c.V + d.V, d.C, d.R) = 1),
      HIDDEN AS (
        SELECT {layer}R, C2 AS C FROM CHOSEN UNION SELECT {layer}R2, C FROM CHOSEN UNION SELECT {layer}R2, C2 FROM CHOSEN),
      JUDGED AS (
        SELECT *, CASE WHEN SMALL THEN 'PRIMARY' WHEN ({layer}R, C) IN ({corner.replace(layer + "R, C", f"({layer}R, C)")}) THEN 'SECONDARY' END AS HIDDEN FROM PRICED)
      SELECT {layer}CASE WHEN R[1] = 1 THEN 'ALL' ELSE R[2] END AS {rows}, CASE WHEN C[1] = 1 THEN 'ALL' ELSE C[2] END AS {columns},
        CASE WHEN HIDDEN IS NULL THEN N END AS {value}, HIDDEN FROM JUDGED"""


FAMILIES = {
    "RARE": ("Q780", "Q783"), "CYSTIC": ("E849",), "FRACTURE": ("S",), "TUMOUR": ("C",), "PRESSURE": ("I10", "I15"), "BONE": ("M",),
    "BIRTH": ("O8",), "INJURY": ("T",),
}
_IN_FAMILIES = "SELECT PSID, " + ", ".join(
    f"bool_or({' OR '.join(_starts('ICD_CODE', prefixes))}) AS {name}" for name, prefixes in FAMILIES.items()
) + " FROM CONFIRMED GROUP BY PSID"


_SEX_AS_OF = """
  SELECT d.*, q.VERSQ, q.GESCHLECHT FROM (SELECT PSID, VSID, ICD_CODE, BJAHR, count(*) AS N_ROWS FROM CONFIRMED GROUP BY ALL) d
  ASOF LEFT JOIN (SELECT * FROM VERSQ WHERE GESCHLECHT IN (1, 2)) q
  ON d.PSID = q.PSID AND d.VSID = q.VSID AND d.BJAHR * 10 + 4 >= q.VERSQ"""

# --- one statement per query: (shared expressions, statement) --------------------------------

STATEMENTS: dict[str, tuple[list[str], str]] = {
    "delivered_csv_cohort": (["RARE"], "SELECT * FROM RARE"),
    "delivered_csv_postcodes": ([], "SELECT PLZ, count(*) AS N_ROWS, min(GEBJAHR) AS GEBJAHR FROM VERS GROUP BY PLZ"),
    "delivered_csv_without_inpatients": (["SEVERAL"], "SELECT * FROM SEVERAL"),
    "delivered_code_list": (
        [],
        f"""SELECT replace(LISTED_CODE, '.', '') AS ICD_CODE, 'Text; the "one" of ' || LISTED_CODE AS ICD_TEXT,
              CAST(length(LISTED_CODE) AS VARCHAR) AS ORPHA_CODE, 'x' AS ORPHA_TEXT, 'level ' || LISTED_CODE AS ORDO_LEVEL FROM ({LISTED} WHERE SRC IN ('O', 'F'))""",
    ),
    "named_views": (
        [],
        """SELECT a.DIAGSICH, q.GESCHLECHT, count(*) AS N_ROWS FROM AMBDIAG a JOIN VERSQ q ON a.PSID = q.PSID AND a.VSID = q.VSID GROUP BY ALL""",
    ),
    "catalogue_tables": (["RARE"], "SELECT * FROM RARE"),
    "replaced_result": (["RARE"], "SELECT * FROM RARE"),
    "written_counts_in_order": (
        ["LEGACY", "PERSONS", "FIRST_SEX"],
        f"""SELECT *, CAST(row_number() OVER (ORDER BY CNT_D_PSID DESC, PLZ2 NULLS FIRST) AS INT) AS LINE FROM (
              SELECT substring(PLZ, 1, 2) AS PLZ2, count(DISTINCT PSID) AS CNT_D_PSID FROM ({_fixed_year("LEGACY", BANDS_FOUR)}) GROUP BY ALL)""",
    ),
    "written_groups_in_order": (
        ["CASES", "HOMES", "AGREED"],
        f"""SELECT *, CAST(row_number() OVER (ORDER BY ICD_GROUP, GESCHLECHT_LABEL, AGE_GROUP) AS INT) AS LINE
            FROM ({_occurrence_counts(_found(IN_CASE_YEAR, "PSID, VSID, BJAHR", TRACKED_CODES, TRACKED_EXACT, " AND DIAGSICH = 'G'"))})""",
    ),
    "dm_demographics_current_year": (
        ["FIRST_PAIR"],
        "SELECT * REPLACE (CAST(year(current_date) - GEBJAHR AS INT) AS ALTER) FROM FIRST_PAIR",
    ),
    "cohort_lower_case": (
        [], "SELECT PSID, ICD_CODE, min(BJAHR) AS BJAHR FROM (SELECT PSID, ICDAMB_CODE AS ICD_CODE, BJAHR FROM AMBDIAG WHERE DIAGSICH = 'G' UNION ALL SELECT PSID, ICDKH_CODE, BJAHR FROM KHDIAG) WHERE ICD_CODE IN ('Q780', 'Q783') GROUP BY ALL",
    ),
    "cube_persons": (
        ["DEMO_REST"],
        """SELECT ICD_CODE, BJAHR, AGE_GROUP, GESCHLECHT_LABEL, CAST(grouping(ICD_CODE, BJAHR, AGE_GROUP, GESCHLECHT_LABEL) AS BIGINT) AS LEVEL,
             count(DISTINCT PSID) AS N_PERSONS
           FROM DEMO_REST GROUP BY CUBE (ICD_CODE, BJAHR, AGE_GROUP, GESCHLECHT_LABEL)""",
    ),
    "rollup_persons": (
        ["CONFIRMED"],
        """SELECT ICD_CODE, BJAHR, CAST(grouping(ICD_CODE, BJAHR) AS BIGINT) AS LEVEL, count(DISTINCT PSID) AS N_PERSONS
           FROM CONFIRMED GROUP BY ROLLUP (ICD_CODE, BJAHR)""",
    ),
    "sketched_persons_by_code": (
        ["CONFIRMED"], "SELECT ICD_CODE, count(DISTINCT PSID) AS N_PERSONS, true AS IN_BOUND FROM CONFIRMED GROUP BY ALL",
    ),
    "sketched_persons_by_area": (
        ["PERSONS"],
        "SELECT substring(PLZ, 1, 1) AS AREA, count(DISTINCT PSID) AS N_PERSONS, true AS IN_BOUND FROM PERSONS WHERE PLZ <> '' GROUP BY ALL",
    ),
    "cohort_membership": (
        ["CONFIRMED"],
        f"""SELECT CAST(g.i AS INT) AS MASK, {", ".join(f"g.i // {1 << i} % 2 = 1 AS {name}" for i, name in enumerate(FAMILIES))},
              count(p.PSID) AS N_PERSONS
            FROM range(256) g(i) LEFT JOIN ({_IN_FAMILIES}) p ON {" AND ".join(f"p.{name} = (g.i // {1 << i} % 2 = 1)" for i, name in enumerate(FAMILIES))}
            GROUP BY g.i""",
    ),
    "cohort_difference": (
        [],
        """(SELECT PSID FROM AMBDIAG WHERE DIAGSICH = 'G' AND ICDAMB_CODE LIKE 'S%' UNION SELECT PSID FROM KHDIAG WHERE ICDKH_CODE LIKE 'S%')
           INTERSECT (
             SELECT PSID FROM AMBDIAG WHERE DIAGSICH = 'G' AND (ICDAMB_CODE LIKE 'I10%' OR ICDAMB_CODE LIKE 'I15%')
             UNION SELECT PSID FROM KHDIAG WHERE ICDKH_CODE LIKE 'I10%' OR ICDKH_CODE LIKE 'I15%')
           EXCEPT (
             SELECT PSID FROM AMBDIAG WHERE DIAGSICH = 'G' AND ICDAMB_CODE LIKE 'C%' UNION SELECT PSID FROM KHDIAG WHERE ICDKH_CODE LIKE 'C%')""",
    ),
    "diagnosis_count_tiles": (
        [],
        """SELECT PSID, N_ROWS, CAST(ntile(10) OVER (ORDER BY N_ROWS, PSID) AS INT) AS TILE
           FROM (SELECT PSID, count(*) AS N_ROWS FROM CLAIM WHERE SRC IN ('O', 'F') GROUP BY PSID)""",
    ),
    "birth_year_quantiles": (
        ["PERSONS"],
        """SELECT s.q AS SHARE, p.GEBJAHR
           FROM (SELECT GEBJAHR, row_number() OVER (ORDER BY GEBJAHR, PSID) AS n, count(*) OVER () AS total FROM PERSONS WHERE GEBJAHR IS NOT NULL) p
           JOIN (SELECT unnest([0.0, 0.1, 0.25, 0.5, 0.9, 1.0])::DOUBLE AS q, unnest([0, 100, 250, 500, 900, 1000]) AS per_mille) s
           ON p.n = greatest(1, (s.per_mille * p.total + 999) // 1000)""",
    ),
    "code_sequences": (
        ["EVENTS"],
        """SELECT PSID, CAST(count(*) AS INT) AS N_CODES, string_agg(BJAHR || ':' || ICD_CODE, '>' ORDER BY BJAHR, ICD_CODE) AS SEQUENCE
           FROM (SELECT PSID, ICD_CODE, min(BJAHR) AS BJAHR FROM EVENTS GROUP BY ALL) GROUP BY PSID""",
    ),
    "code_transitions": (
        ["FIRST_YEARS"],
        """SELECT a.ICD_CODE AS CODE, b.ICD_CODE AS LATER_CODE, count(*) AS N_PERSONS
           FROM FIRST_YEARS a JOIN FIRST_YEARS b ON a.PSID = b.PSID AND b.BJAHR - a.BJAHR BETWEEN 1 AND 2 GROUP BY ALL""",
    ),
    "followed_by": (
        ["EVENTS"],
        """SELECT a.PSID, a.BJAHR AS FIRST_YEAR, b.BJAHR AS THEN_YEAR FROM EVENTS a JOIN EVENTS b
             ON a.PSID = b.PSID AND b.BJAHR - a.BJAHR BETWEEN 1 AND 2 WHERE a.ICD_CODE LIKE 'E849%' AND b.ICD_CODE LIKE 'S%'
           QUALIFY row_number() OVER (PARTITION BY a.PSID ORDER BY a.BJAHR, b.BJAHR) = 1""",
    ),
    "incremental_cohort": (["FIRST_YEARS"], "SELECT * FROM FIRST_YEARS WHERE ICD_CODE LIKE 'E849%'"),
    "suppressed_age_sex": (
        ["AGE_SEX_EIGHT"],
        f"""SELECT * FROM ({_suppressed("SELECT * FROM AGE_SEX_EIGHT", "ALTERSGRUPPE", "GESCHLECHT_LABEL", ["ICDAMB_CODE", "BJAHR"], "CNT_D_PSID", 5)})""",
    ),
    "suppressed_code_sex": (
        ["LISTED_COHORTS", "PERSONS", "FIRST_SEX"],
        f"""SELECT * FROM ({_suppressed(f"SELECT ICD_CODE || ' ' || BJAHR AS CODE_YEAR, GESCHLECHT_LABEL, count(*) AS N FROM ({_fixed_year('LISTED_COHORTS', BANDS_ADULT)}) GROUP BY ALL", "CODE_YEAR", "GESCHLECHT_LABEL", [], "N", 10)})""",
    ),
    "insured_spells": (
        ["QUARTERS"],
        f"""SELECT PSID, CAST(row_number() OVER (PARTITION BY PSID ORDER BY min(Q)) AS INT) AS SPELL,
              {_quarter_id("min(Q)")} AS SPELL_START, {_quarter_id("max(Q)")} AS SPELL_END, count(*) AS N_QUARTERS
            FROM (SELECT PSID, Q, Q - row_number() OVER (PARTITION BY PSID ORDER BY Q) AS RUN FROM QUARTERS)
            GROUP BY PSID, RUN""",
    ),
    "insured_spells_with_gaps": (
        [],
        f"""SELECT PSID, VSID, SPELL, {_quarter_id("min(Q)")} AS SPELL_START, {_quarter_id("max(Q)")} AS SPELL_END, count(*) AS N_QUARTERS
            FROM ({_spells("PSID, VSID", f"SELECT DISTINCT PSID, VSID, {_QUARTER} AS Q FROM VERSQ", 2)}) GROUP BY ALL""",
    ),
    "diagnosis_spells": (
        ["EVENTS", "QUARTERS"],
        f"""SELECT d.PSID, d.ICD_CODE, d.BJAHR, d.N_ROWS, s.SPELL, {_quarter_id("s.A")} AS SPELL_START, {_quarter_id("s.Z")} AS SPELL_END,
              CAST(least(d.BJAHR * 4 + 3, s.Z) - greatest(d.BJAHR * 4, s.A) + 1 AS INT) AS QUARTERS_IN_YEAR
            FROM EVENTS d JOIN (
              SELECT PSID, SPELL, min(Q) AS A, max(Q) AS Z FROM ({_spells("PSID", "SELECT * FROM QUARTERS", 1)}) GROUP BY ALL) s
            ON d.PSID = s.PSID AND s.A <= d.BJAHR * 4 + 3 AND s.Z >= d.BJAHR * 4""",
    ),
    "person_quarters": (
        ["QUARTERS"],
        """SELECT CAST(Q // 4 AS INT) AS BJAHR, count(DISTINCT PSID) AS N_PERSONS, count(*) AS PERSON_QUARTERS
           FROM QUARTERS GROUP BY ALL""",
    ),
    "master_as_of": (
        ["EVENTS"],
        """SELECT d.*, v.MASTER_YEAR, v.GEBJAHR, v.PLZ FROM EVENTS d ASOF LEFT JOIN (
             SELECT PSID, BJAHR AS MASTER_YEAR, min(GEBJAHR) AS GEBJAHR, min(PLZ) AS PLZ FROM VERS GROUP BY ALL) v
           ON d.PSID = v.PSID AND d.BJAHR > v.MASTER_YEAR""",
    ),
    "sex_as_of": (["CONFIRMED"], _SEX_AS_OF),
    "sex_as_of_in_bins": (["CONFIRMED"], _SEX_AS_OF),
    "case_types": (
        ["EVENTS"],
        """SELECT PSID, ICD_CODE, BJAHR, YEARS_SINCE, CASE WHEN YEARS_SINCE <= 2 THEN 'PREVALENT' ELSE 'INCIDENT' END AS CASE_TYPE
           FROM (SELECT *, BJAHR - lag(BJAHR) OVER (PARTITION BY PSID, ICD_CODE ORDER BY BJAHR) AS YEARS_SINCE FROM EVENTS)""",
    ),
    "case_types_observed": (["CASE_TYPES"], "SELECT * FROM CASE_TYPES"),
    "episodes": (
        ["EVENTS"],
        """SELECT PSID, ICD_CODE, EPISODE, min(BJAHR) AS FIRST_YEAR, max(BJAHR) AS LAST_YEAR, count(*) AS N_YEARS FROM (
             SELECT *, CAST(sum(NEW) OVER (PARTITION BY PSID, ICD_CODE ORDER BY BJAHR) AS INT) AS EPISODE FROM (
               SELECT *, CASE WHEN BJAHR - lag(BJAHR) OVER (PARTITION BY PSID, ICD_CODE ORDER BY BJAHR) <= 2 THEN 0 ELSE 1 END AS NEW
               FROM EVENTS))
           GROUP BY PSID, ICD_CODE, EPISODE""",
    ),
    "incidence": (
        ["CASE_TYPES"],
        """SELECT c.ICD_CODE, c.BJAHR, count(*) FILTER (CASE_TYPE = 'INCIDENT') AS N_INCIDENT,
             count(*) FILTER (CASE_TYPE = 'PREVALENT') AS N_PREVALENT, count(*) FILTER (CASE_TYPE = 'UNOBSERVED') AS N_UNOBSERVED,
             any_value(p.N) AS PERSON_QUARTERS,
             count(*) FILTER (CASE_TYPE = 'INCIDENT') * 4000.0::DOUBLE / any_value(p.N)::DOUBLE AS PER_1000_PERSON_YEARS
           FROM CASE_TYPES c LEFT JOIN (SELECT Q // 4 AS BJAHR, count(*) AS N FROM QUARTERS GROUP BY ALL) p USING (BJAHR)
           GROUP BY c.ICD_CODE, c.BJAHR""",
    ),
    "cohort_exact": (["RARE"], "SELECT * FROM RARE"),
    "cohort_prefix": (
        [],
        """SELECT PSID, ICD_CODE, min(BJAHR) AS BJAHR FROM (
             SELECT PSID, ICDAMB_CODE AS ICD_CODE, BJAHR FROM AMBDIAG
             WHERE ICDAMB_CODE LIKE 'E849%' AND DIAGSICH = 'G'
             UNION ALL SELECT PSID, ICDKH_CODE, BJAHR FROM KHDIAG WHERE ICDKH_CODE LIKE 'E849%')
           GROUP BY ALL""",
    ),
    "cohort_multi_exact": (["SEVERAL"], "SELECT * FROM SEVERAL"),
    "cohort_multi_prefix": (
        [],
        """SELECT DISTINCT PSID, ICDAMB_CODE, BJAHR FROM AMBDIAG
           WHERE ICDAMB_CODE LIKE 'C8%' OR ICDAMB_CODE LIKE 'E84%'""",
    ),
    "cohort_secondary": (["CASES"], "SELECT * FROM CASES"),
    "cohort_secondary_relabelled": (
        [],
        """SELECT PSID, VSID, 'Q780' AS ICD_CODE, min(BJAHR) AS BJAHR FROM (
             SELECT PSID, VSID, BJAHR FROM AMBDIAG WHERE ICDAMB_CODE = 'Q780' AND DIAGSICH = 'G'
             UNION ALL SELECT PSID, VSID, BJAHR FROM KHDIAG WHERE 'Q780' IN (ICDKH_CODE, SEKICD_CODE))
           GROUP BY ALL""",
    ),
    "cohort_all_years": (["LEGACY"], "SELECT * FROM LEGACY"),
    "cohort_by_code_list": (["LISTED_COHORTS"], "SELECT * FROM LISTED_COHORTS"),
    "cohort_by_prefix_list": (
        [],
        " UNION ALL ".join(
            f"""SELECT PSID, '{p}' AS LISTED_CODE, ICD_CODE, min(BJAHR) AS BJAHR FROM (
                  SELECT PSID, ICDAMB_CODE AS ICD_CODE, BJAHR FROM AMBDIAG WHERE DIAGSICH = 'G'
                  UNION ALL SELECT PSID, ICDKH_CODE, BJAHR FROM KHDIAG)
                WHERE ICD_CODE LIKE '{p}%' GROUP BY ALL"""
            for p in PREFIXES
        ),
    ),
    "cohort_by_list_secondary": (
        [],
        " UNION ALL ".join(
            f"""SELECT PSID, VSID, '{p}' AS LISTED_CODE, ICD_CODE, min(BJAHR) AS BJAHR FROM (
                  SELECT PSID, VSID, ICDAMB_CODE AS ICD_CODE, BJAHR FROM AMBDIAG
                  WHERE ICDAMB_CODE = '{p}' AND DIAGSICH = 'G'
                  UNION ALL SELECT PSID, VSID, ICDKH_CODE, BJAHR FROM KHDIAG WHERE '{p}' IN (ICDKH_CODE, SEKICD_CODE))
                GROUP BY ALL"""
            for p in LISTED_CODES
        ),
    ),
    "unified_diagnoses": (
        [],
        """SELECT 'AMB' AS SRC, ICDAMB_CODE AS ICD_CODE, NULL::VARCHAR AS SEK_CODE, DIAGSICH, count(*) AS N_ROWS
           FROM AMBDIAG GROUP BY ALL
           UNION ALL
           SELECT 'KH', ICDKH_CODE, SEKICD_CODE, NULL, count(*) FROM KHDIAG GROUP BY ALL""",
    ),
    "case_control_several_codes": (
        ["TWO_CASES", "TWO_REST", "HOMES", "AGREED"],
        f"""SELECT ICD_CODE, AGE_GROUP AS ALTERSGRUPPE, GESCHLECHT_LABEL, CAST(sum(n) AS BIGINT) AS CNT_D_PSID FROM (
              SELECT ICD_CODE, BJAHR, AGE_GROUP, GESCHLECHT_LABEL, count(DISTINCT PSID) AS n FROM (
                SELECT i.PSID, i.BJAHR, i.ICD_CODE, s.GESCHLECHT_LABEL,
                  {_band("(i.BJAHR - h.GEBJAHR)", BANDS_EVENT, "'Unknown'")} AS AGE_GROUP
                FROM TWO_CASES i JOIN HOMES h USING (PSID, VSID) JOIN AGREED s USING (PSID, VSID)
                UNION ALL
                SELECT i.PSID, i.BJAHR, '!Q780, Q783', s.GESCHLECHT_LABEL, {_band("(i.BJAHR - h.GEBJAHR)", BANDS_EVENT)}
                FROM TWO_REST i JOIN HOMES h USING (PSID, VSID) JOIN AGREED s USING (PSID, VSID))
              WHERE AGE_GROUP IS NOT NULL AND GESCHLECHT_LABEL <> 'Unknown'
              GROUP BY ALL)
            GROUP BY ALL""",
    ),
    "cohort_size": (["SEVERAL"], "SELECT count(DISTINCT PSID) AS N_PERSONS FROM SEVERAL"),
    "remaining_population": (["REST"], "SELECT * FROM REST"),
    "remaining_population_rows": (
        ["LEGACY_REST"],
        "SELECT PSID, ICD_CODE, BJAHR, count(*) AS N_ROWS FROM LEGACY_REST GROUP BY ALL",
    ),
    "remaining_population_outpatient": (["SEVERAL_REST"], "SELECT * FROM SEVERAL_REST"),
    "sex_consensus": (["AGREED"], "SELECT * FROM AGREED"),
    "first_sex_row": (["FIRST_SEX"], "SELECT * FROM FIRST_SEX"),
    "demographics_rd": (["DEMO_CASES"], "SELECT * FROM DEMO_CASES"),
    "demographics_remaining": (["DEMO_REST"], "SELECT * FROM DEMO_REST"),
    "demographics_fixed_year": (["RARE", "PERSONS", "FIRST_SEX"], _fixed_year("RARE", BANDS_ADULT)),
    "demographics_m2m": (
        ["SEVERAL"],
        f"""SELECT DISTINCT s.PSID, s.ICDAMB_CODE, s.BJAHR, v.GEBJAHR, q.GESCHLECHT, {YEAR} - v.GEBJAHR AS ALTER
            FROM SEVERAL s JOIN VERS v ON s.PSID = v.PSID JOIN VERSQ q ON s.PSID = q.PSID
            WHERE v.GEBJAHR IS NOT NULL AND q.GESCHLECHT IN (1, 2)""",
    ),
    "demographics_m2m_remaining": (
        ["SEVERAL_REST"],
        f"""SELECT DISTINCT r.PSID, r.ICDAMB_CODE, r.BJAHR, v.GEBJAHR, q.GESCHLECHT, {YEAR} - v.GEBJAHR AS ALTER
            FROM SEVERAL_REST r JOIN VERS v ON r.PSID = v.PSID JOIN VERSQ q ON r.PSID = q.PSID
            WHERE v.GEBJAHR IS NOT NULL AND q.GESCHLECHT IN (1, 2)""",
    ),
    "age_sex_case_control_persons": (
        ["DEMO_CASES", "DEMO_REST"],
        """SELECT ICD_CODE, AGE_GROUP AS ALTERSGRUPPE, GESCHLECHT_LABEL, count(DISTINCT PSID) AS CNT_D_PSID
           FROM (SELECT PSID, ICD_CODE, AGE_GROUP, GESCHLECHT_LABEL FROM DEMO_CASES
                 UNION ALL SELECT PSID, '!Q780', AGE_GROUP, GESCHLECHT_LABEL FROM DEMO_REST)
           WHERE AGE_GROUP IS NOT NULL AND GESCHLECHT_LABEL IS NOT NULL
           GROUP BY ALL""",
    ),
    "age_sex_case_control": (
        ["DEMO_CASES", "DEMO_REST"],
        """SELECT ICD_CODE, AGE_GROUP AS ALTERSGRUPPE, GESCHLECHT_LABEL, CAST(sum(n) AS BIGINT) AS CNT_D_PSID FROM (
             SELECT ICD_CODE, BJAHR, AGE_GROUP, GESCHLECHT_LABEL, count(DISTINCT PSID) AS n
             FROM DEMO_CASES GROUP BY ALL
             UNION ALL
             SELECT '!Q780', BJAHR, AGE_GROUP, GESCHLECHT_LABEL, count(DISTINCT PSID)
             FROM DEMO_REST GROUP BY ALL)
           WHERE AGE_GROUP IS NOT NULL AND GESCHLECHT_LABEL IS NOT NULL
           GROUP BY ALL""",
    ),
    "age_sex_by_code": (
        ["LISTED_COHORTS", "PERSONS", "FIRST_SEX"],
        f"""SELECT ICD_CODE, BJAHR, AGE_GROUP AS ALTERSGRUPPE, GESCHLECHT_LABEL, count(PSID) AS CNT_D_PSID
            FROM ({_fixed_year("LISTED_COHORTS", BANDS_ADULT)}) GROUP BY ALL""",
    ),
    "age_sex_4band": (
        ["LEGACY", "PERSONS", "FIRST_SEX"],
        f"""SELECT ICD_CODE, BJAHR, AGE_GROUP AS ALTERSGRUPPE, GESCHLECHT_LABEL, count(PSID) AS CNT_D_PSID
            FROM ({_fixed_year("LEGACY", BANDS_FOUR)}) GROUP BY ALL""",
    ),
    "age_sex_4band_remaining": (
        ["LEGACY_REST", "PERSONS", "FIRST_SEX"],
        f"""SELECT ICD_CODE, BJAHR, AGE_GROUP AS ALTERSGRUPPE, GESCHLECHT_LABEL, count(PSID) AS CNT_D_PSID
            FROM ({_fixed_year("LEGACY_REST", BANDS_FOUR)}) GROUP BY ALL""",
    ),
    "age_sex_8band": (["AGE_SEX_EIGHT"], "SELECT * FROM AGE_SEX_EIGHT"),
    "age_sex_8band_persons": (
        ["SEVERAL"],
        f"""SELECT s.ICDAMB_CODE, s.BJAHR, {_band(f"({YEAR} - v.GEBJAHR)", BANDS_EIGHT)} AS ALTERSGRUPPE,
              {_sex("q.GESCHLECHT")} AS GESCHLECHT_LABEL, count(DISTINCT s.PSID) AS CNT_D_PSID
            FROM SEVERAL s JOIN VERS v ON s.PSID = v.PSID JOIN VERSQ q ON s.PSID = q.PSID
            WHERE v.GEBJAHR IS NOT NULL AND q.GESCHLECHT IN (1, 2)
            GROUP BY ALL""",
    ),
    "age_sex_remaining": (["AGE_SEX_REST"], "SELECT * FROM AGE_SEX_REST"),
    "plz1_by_code": (
        ["LISTED_COHORTS", "PERSONS", "FIRST_SEX"],
        f"""SELECT ICD_CODE, substring(PLZ, 1, 1) AS PLZ, count(DISTINCT PSID) AS CNT_D_PSID
            FROM ({_fixed_year("LISTED_COHORTS", BANDS_ADULT)}) GROUP BY ICD_CODE, substring(PLZ, 1, 1)""",
    ),
    "plz2_dist": (
        ["LEGACY", "PERSONS", "FIRST_SEX"],
        f"""SELECT substring(PLZ, 1, 2) AS PLZ2, count(DISTINCT PSID) AS CNT_D_PSID
            FROM ({_fixed_year("LEGACY", BANDS_FOUR)}) GROUP BY ALL""",
    ),
    "plz_case_control": (["DEMO_CASES", "DEMO_REST"], _plz_case_control("PLZ")),
    "plz1_case_control": (["DEMO_CASES", "DEMO_REST"], _plz_case_control("left(PLZ, 1)")),
    "plz_list_by_group": (
        ["LEGACY", "PERSONS", "FIRST_SEX"],
        f"""SELECT ICD_CODE, BJAHR, AGE_GROUP AS ALTERSGRUPPE, GESCHLECHT_LABEL, count(PSID) AS CNT_D_PSID,
              string_agg(DISTINCT PLZ, ',' ORDER BY PLZ) AS PLZ
            FROM ({_fixed_year("LEGACY", BANDS_FOUR)}) GROUP BY ICD_CODE, BJAHR, AGE_GROUP, GESCHLECHT_LABEL""",
    ),
    "specific_icd_rd": (
        ["CASES", "HOMES", "AGREED"],
        _occurrence_counts(
            _found(IN_CASE_YEAR, "PSID, VSID, BJAHR", TRACKED_CODES, TRACKED_EXACT, " AND DIAGSICH = 'G'")
        ),
    ),
    "specific_icd_rd_legacy": (
        ["CASES", "HOMES", "AGREED"],
        _occurrence_counts(
            _found(IN_CASE_YEAR, "PSID, VSID, BJAHR", TRACKED_CODES, TRACKED_EXACT, " AND DIAGSICH = 'G'", True)
        ),
    ),
    "specific_icd_any_case_year": (
        ["CASE_YEARS", "HOMES", "AGREED"],
        _occurrence_counts(
            _found(IN_ANY_CASE_YEAR, "PSID, VSID, BJAHR", TRACKED_CODES, TRACKED_EXACT, " AND DIAGSICH = 'G'")
        ),
    ),
    "specific_icd_remaining": (["REST", "HOMES", "AGREED"], _occurrence_counts(REST_FOUND)),
    "specific_icd_all_years": (["LEGACY"], LEGACY_FOUND),
    "specific_icd_left": (
        ["LEGACY", "PERSONS", "FIRST_SEX"],
        f"""SELECT o.ICD_GROUP, o.BJAHR, d.GESCHLECHT_LABEL, d.AGE_GROUP, count(DISTINCT o.PSID) AS CNT_D_PSID
            FROM ({LEGACY_FOUND}) o LEFT JOIN ({_fixed_year("LEGACY", BANDS_FOUR)}) d ON o.PSID = d.PSID
            GROUP BY ALL""",
    ),
    "comorbidity_top20": (["COMORBID_TOP"], "SELECT * FROM COMORBID_TOP"),
    "comorbidity_top20_by_base_year": (
        ["COMORBID"],
        """SELECT c.*, CAST(dense_rank() OVER (
               PARTITION BY ICDAMB_CODE_BASE, BJAHR ORDER BY CNT_D_PSID DESC) AS INT) AS RN
           FROM COMORBID c JOIN (
             SELECT ICDAMB_CODE AS ICDAMB_CODE_BASE, BJAHR, count(DISTINCT PSID) AS persons FROM SEVERAL GROUP BY ALL
           ) b USING (ICDAMB_CODE_BASE, BJAHR)
           WHERE c.CNT_D_PSID >= ceil(b.persons * CAST(0.10 AS DOUBLE))
           QUALIFY RN <= 20""",
    ),
    "dm_comorbidities": (["ROW_COUNTS"], "SELECT * FROM ROW_COUNTS"),
    "dm_top20_labelled": (
        ["ROW_COUNTS", "LATEST_LABELS"],
        """SELECT ICDAMB_CODE, n, label FROM (SELECT * FROM ROW_COUNTS ORDER BY n DESC, ICDAMB_CODE LIMIT 20)
           LEFT JOIN LATEST_LABELS USING (ICDAMB_CODE)""",
    ),
    "dm_labelled_codes": (
        ["ROW_COUNTS", "LATEST_LABELS"],
        """SELECT ICDAMB_CODE AS ICD_codes, n, label FROM ROW_COUNTS LEFT JOIN LATEST_LABELS USING (ICDAMB_CODE)""",
    ),
    "dm_demographics": (["FIRST_PAIR"], "SELECT * FROM FIRST_PAIR"),
    "dm_prefix_filter": ([], "SELECT * FROM AMBDIAG WHERE ICDAMB_CODE LIKE 'E84%'"),
    "dm_exact_g_filter": ([], "SELECT * FROM AMBDIAG WHERE regexp_full_match(ICDAMB_CODE, 'E849G?')"),
    "dm_age_histogram": (
        ["DIAGNOSED"],
        """SELECT GESCHLECHT, CAST(ceil((ALTER - 5) / 10.0) * 10 AS INT) AS AGE_BIN, count(*) AS n
           FROM DIAGNOSED WHERE ALTER IS NOT NULL GROUP BY ALL""",
    ),
    "dm_age_histogram_persons": (
        ["DIAGNOSED"],
        """SELECT GESCHLECHT, CAST(ceil((ALTER - 5) / 10.0) * 10 AS INT) AS AGE_BIN, count(DISTINCT PSID) AS n
           FROM DIAGNOSED WHERE ALTER IS NOT NULL GROUP BY ALL""",
    ),
    "dm_sex_share": (["DIAGNOSED"], _sex_share("count(*)")),
    "dm_sex_share_persons": (["DIAGNOSED"], _sex_share("count(DISTINCT PSID)")),
    "code_list_normalise": (
        [],
        f"SELECT LISTED_CODE, replace(LISTED_CODE, '.', '') AS ICD_CODE FROM ({LISTED})",
    ),
    "code_list_split": (
        [],
        f"""SELECT ICDAMB_CODE AS ICD_CODE FROM AMBDIAG UNION SELECT substring(ICDAMB_CODE, 1, 3) FROM AMBDIAG
            EXCEPT SELECT ICD FROM CLAIM WHERE ICD IN ({_quoted(TRACKED_EXACT)})""",
    ),
    "inspect_top_codes": (
        ["AGE_SEX_REST"],
        """SELECT ICDAMB_CODE, CAST(sum(CNT_D_PSID) AS BIGINT) AS TOTAL FROM AGE_SEX_REST
           GROUP BY ICDAMB_CODE ORDER BY TOTAL DESC, ICDAMB_CODE LIMIT 10""",
    ),
    "inspect_code_totals": (
        ["AGE_SEX_EIGHT"],
        "SELECT ICDAMB_CODE, CAST(sum(CNT_D_PSID) AS BIGINT) AS TOTAL FROM AGE_SEX_EIGHT GROUP BY ALL",
    ),
    "inspect_sex_totals": (
        ["AGE_SEX_EIGHT"],
        "SELECT GESCHLECHT_LABEL, CAST(sum(CNT_D_PSID) AS BIGINT) AS TOTAL FROM AGE_SEX_EIGHT GROUP BY ALL",
    ),
    "inspect_top_comorbidities": (
        ["COMORBID_TOP"],
        """SELECT ICDAMB_CODE_COMORBID, CAST(sum(CNT_D_PSID) AS BIGINT) AS TOTAL FROM COMORBID_TOP
           GROUP BY ALL ORDER BY TOTAL DESC, ICDAMB_CODE_COMORBID LIMIT 10""",
    ),
    "result_dictionary": (
        [],
        " UNION ALL ".join(
            f"""SELECT '{table}' AS TABELLENNAME,
                  '{DICTIONARY_SUBJECT}' AS KLASSIFIKATION_VERSICHERTENBEZUG_LEISTUNGSTRAEGERBEZUG,
                  '{FREQUENCY_TABLE}' AS KLASSIFIKATION_STATISTISCH,
                  '{text}' || codes AS BESCHREIBUNG, '{INCLUSION_TEXT}' || codes AS EINSCHLUSS_FILTERKRITERIEN
                FROM (SELECT string_agg(DISTINCT ICD, ', ' ORDER BY ICD) AS codes FROM CLAIM
                      WHERE ICD LIKE 'E849%' AND (SRC = 'F' OR DIAGSICH = 'G'))"""
            for table, text in DICTIONARY_TABLES
        ),
    ),
}


# Tables of whole reports that equal a single query's result.
STATEMENTS |= {
    report: STATEMENTS[query]
    for report, query in {
        "report_tracer_age_sex": "age_sex_by_code",
        "report_tracer_plz": "plz1_by_code",
        "report_case_control_age_sex": "age_sex_case_control",
        "report_case_control_codes": "specific_icd_rd",
        "report_case_control_codes_rest": "specific_icd_remaining",
        "report_case_control_plz": "plz_case_control",
        "report_multi_code_age_sex": "age_sex_8band",
        "report_multi_code_comorbidities": "comorbidity_top20",
        "report_multi_code_rest": "age_sex_remaining",
        "report_multi_code_every_row": "age_sex_8band_persons",
        "report_fixed_year_age_sex": "age_sex_4band",
        "report_fixed_year_codes": "specific_icd_left",
        "report_fixed_year_rest": "age_sex_4band_remaining",
        "report_fixed_year_plz": "plz2_dist",
        "report_single_code_ages": "dm_age_histogram",
        "report_single_code_sexes": "dm_sex_share",
        "report_single_code_counts": "dm_comorbidities",
        "report_single_code_top20": "dm_top20_labelled",
        "report_single_code_codes": "dm_labelled_codes",
    }.items()
}
STATEMENTS["report_tracer_plz2"] = (
    ["LISTED_COHORTS", "PERSONS", "FIRST_SEX"],
    f"""SELECT ICD_CODE, substring(PLZ, 1, 2) AS PLZ, count(DISTINCT PSID) AS CNT_D_PSID
        FROM ({_fixed_year("LISTED_COHORTS", BANDS_ADULT)}) GROUP BY ICD_CODE, substring(PLZ, 1, 2)""",
)


def _closure(names: list[str]) -> list[str]:
    """The named expressions and what they build on, dependencies first."""
    ordered: list[str] = []
    for name in names:
        for item in [*_closure(NEEDS.get(name, [])), name]:
            if item not in ordered:
                ordered.append(item)
    return ordered


def statement(name: str, claims: bool = True) -> str:
    """The check SQL of a query; without ``claims`` it expects the claims tables to exist."""
    shared, body = STATEMENTS[name]
    parts = [f"{item} AS ({SHARED[item]})" for item in _closure(shared)]
    if claims:
        parts = [CLAIMS_SQL.strip(), *parts]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def check_sql() -> dict[str, str]:
    return {name: statement(name) for name in STATEMENTS}


def looped_code_report(engine, codes) -> list:
    """The code-list report one code at a time, on an engine that holds the claims tables.

    For contrast only: every round scans the diagnoses and reduces the master tables again.
    """
    results = []
    for code in codes:
        engine.execute(
            f"""CREATE OR REPLACE TEMP TABLE MEMBERS AS SELECT PSID, ICD_CODE, min(BJAHR) AS BJAHR FROM (
                  SELECT PSID, ICDAMB_CODE AS ICD_CODE, BJAHR FROM AMBDIAG
                  WHERE ICDAMB_CODE = '{code}' AND DIAGSICH = 'G'
                  UNION ALL SELECT PSID, ICDKH_CODE, BJAHR FROM KHDIAG WHERE ICDKH_CODE = '{code}') GROUP BY ALL"""
        )
        engine.execute(
            f"""CREATE OR REPLACE TEMP TABLE DESCRIBED AS
                WITH PERSONS AS ({SHARED["PERSONS"]}), FIRST_SEX AS ({SHARED["FIRST_SEX"]})
                {_fixed_year("MEMBERS", BANDS_ADULT)}"""
        )
        for counts in (
            "SELECT ICD_CODE, BJAHR, AGE_GROUP, GESCHLECHT_LABEL, count(PSID) FROM DESCRIBED GROUP BY ALL",
            "SELECT substring(PLZ, 1, 1), count(DISTINCT PSID) FROM DESCRIBED GROUP BY ALL",
        ):
            results.append(engine.execute(counts).fetchall())
    return results
