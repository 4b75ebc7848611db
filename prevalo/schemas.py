"""Explicit schemas of the source tables. Postcodes and codes are text, never inferred."""

from pyspark.sql import types as T


def claims_schemas(id_type: T.DataType | None = None) -> dict[str, T.StructType]:
    """Columns read from the four claims tables; ``id_type`` is the type of PSID and VSID."""
    key = id_type or T.LongType()
    whole, text = T.IntegerType(), T.StringType()
    columns = {
        "AMBDIAG": {"BJAHR": whole, "ICDAMB_CODE": text, "DIAGSICH": text},
        "KHDIAG": {"BJAHR": whole, "ICDKH_CODE": text, "SEKICD_CODE": text},
        "VERS": {"GEBJAHR": whole, "PLZ": text},
        "VERSQ": {"VERSQ": whole, "GESCHLECHT": whole},
    }
    return {
        table: T.StructType(
            [T.StructField("PSID", key), T.StructField("VSID", key)]
            + [T.StructField(name, kind) for name, kind in fields.items()]
        )
        for table, fields in columns.items()
    }


#: Columns that are kept where a table has them: the year of a master row, which as-of joins need.
OPTIONAL_COLUMNS = {"VERS": {"BJAHR": T.IntegerType()}}

CODE_LIST_COLUMNS = ("ICD_CODE", "ICD_TEXT", "ORPHA_CODE", "ORPHA_TEXT", "ORDO_LEVEL")
