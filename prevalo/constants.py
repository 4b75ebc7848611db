"""Codes, labels, band edges and texts that results must carry verbatim."""

# Diagnosis certainty, placeholder code, diagnosis sources.
CONFIRMED = "G"
PLACEHOLDER_CODE = "UUU"
OUTPATIENT = "AMB"
INPATIENT = "KH"

# Sex codes of the quarterly master data and their labels.
SEX_LABELS = {1: "Female", 2: "Male"}
UNKNOWN = "Unknown"

# Age bands as (lowest age, highest age, label); None leaves that side open.
BANDS_ADULT = ((0, 17, "0-17"), (18, 59, "18-59"), (60, None, "60+"))
BANDS_EVENT = ((0, 18, "0-18"), (19, 49, "19-49"), (50, None, "50+"))
BANDS_FOUR = ((0, 19, "0-19"), (20, 39, "20-39"), (40, 59, "40-59"), (60, None, "60+"))
BANDS_EIGHT = (
    (None, 17, "0-17"),
    (18, 29, "18-29"),
    (30, 39, "30-39"),
    (40, 49, "40-49"),
    (50, 59, "50-59"),
    (60, 69, "60-69"),
    (70, 79, "70-79"),
    (80, None, "80+"),
)

# Co-occurring codes that are tracked by exact match and by prefix.
TRACKED_EXACT = ("R53", "F480", "T733", "O80", "O81", "O82")
TRACKED_EXACT_SHORT = ("R53", "F480", "T733")
TRACKED_CODES = (
    "S02", "S12", "S22", "S32", "S42", "S52", "S62", "S72", "S82", "S92", "T02", "T08",
    "T10", "T12", "M54", "I10", "I15", "R52", "M25", "M796", "M798", "M799", "O30",
)
TRACKED_CODES_SHORT = TRACKED_CODES[:-1]

# Data-dictionary texts.
DICTIONARY_SUBJECT = "Versichertenbezug"
FREQUENCY_TABLE = "Häufigkeitstabelle"
CASE_COUNT = "Fallzahl"
INCLUSION_TEXT = "Versicherte mit ambulanter Diagnose(n): "
DICTIONARY_TABLES = (
    ("RT_AGE_SEX_DIST", "Alters- und Geschlechtsverteilung für ICD-10: "),
    ("RT_COMORBIDITIES", "Top {top_n} Komorbiditäten (≥{percent:g}% Prävalenz) für ICD-10: "),
)
DICTIONARY_COLUMNS = (
    ("RT_AGE_SEX_DIST", FREQUENCY_TABLE, "BJAHR", "Berichtsjahr aus AMBDIAG"),
    ("RT_AGE_SEX_DIST", FREQUENCY_TABLE, "ICDAMB_CODE", "ICD-10 Code der seltenen Erkrankung"),
    ("RT_AGE_SEX_DIST", FREQUENCY_TABLE, "ALTERSGRUPPE", "Altersgruppe der betrachteten Versicherten"),
    ("RT_AGE_SEX_DIST", FREQUENCY_TABLE, "GESCHLECHT_LABEL", "Geschlecht der betrachteten Versicherten"),
    ("RT_AGE_SEX_DIST", CASE_COUNT, "CNT_D_PSID", "Anzahl distinkt gezählter Versicherten"),
    ("RT_COMORBIDITIES", FREQUENCY_TABLE, "BJAHR", "Behandlungsjahr aus AMBDIAG"),
    ("RT_COMORBIDITIES", FREQUENCY_TABLE, "ICDAMB_CODE_BASE", "ICD-10 Code der seltenen Erkrankung"),
    ("RT_COMORBIDITIES", FREQUENCY_TABLE, "ICDAMB_CODE_COMORBID", "Komorbide ICD-10 Diagnose"),
    ("RT_COMORBIDITIES", CASE_COUNT, "CNT_D_PSID", "Anzahl distinkt gezählter Versicherten mit dieser Komorbidität"),
)

# Fixed value: first catalogue year accepted for diagnosis labels.
FIRST_LABEL_YEAR = 2019
