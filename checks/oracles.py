"""The same results in SQL for DuckDB, written from the rules, not from the Spark plans."""

from checks import queries as q
from checks.adapters import ctes
from letterflow.sources.schemas import KINDS

ORACLES = {}


def rows(entries):
    return ", ".join("(" + ", ".join(repr(v) for v in e) + ")" for e in entries)


def select(name, views, text, *more):
    """Register a query over views and further CTEs; `text` is the final SELECT."""
    ORACLES[name] = ",\n".join([ctes(*views), *more]) + "\n" + text


def ratio(a, b):
    return (f"(CASE WHEN {b} = 0 THEN CASE WHEN {a} > 0 THEN CAST('Infinity' AS DOUBLE) "
            f"WHEN {a} < 0 THEN CAST('-Infinity' AS DOUBLE) END ELSE {a} / {b} END)")


def date_of(day, month, year):
    return (f"CAST(try_strptime(CAST({day} AS VARCHAR) || '/' || CAST({month} AS VARCHAR) || '/' "
            f"|| CAST({year} AS VARCHAR), '%d/%m/%Y') AS DATE)")


def text_date(c):
    return f"CAST(try_strptime({c}, '%d/%m/%Y') AS DATE)"


def birth_year(c):
    return f"CASE WHEN {c} > 1000 THEN {c} WHEN {c} < 100 THEN {c} + 1900 END"


def visit_year(c):
    return f"CASE WHEN {c} > 1000 THEN {c} WHEN {c} < 25 THEN {c} + 2000 WHEN {c} > 25 THEN {c} + 1900 END"


def clean_id(c):
    return f"replace(replace({c}, ' ', ''), '-', '')"


GENDER = "CASE WHEN Gender = 'male' THEN 1 WHEN Gender = 'female' THEN 2 WHEN Gender IS NULL THEN 9 END"

# --- scalars -------------------------------------------------------------------------------


def cleaned(c):
    return f"CASE WHEN trim({c}) IN ('', 'NA', 'null', 'NULL') THEN NULL ELSE trim({c}) END"


select("null_tokens", ["typed_v"], f"""SELECT LETTER, {cleaned('DateText')} AS DateText,
  {cleaned('NumberText')} AS NumberText, {cleaned('Padded')} AS Padded FROM typed_v""")
select("numeric_cast", ["typed_v"],
       "SELECT LETTER, TRY_CAST(trim(NumberText) AS DOUBLE) AS number FROM typed_v")
select("parse_dates", ["typed_v"],
       f"SELECT LETTER, {text_date('DateText')} AS date FROM typed_v")
select("date_from_parts", ["ident_v"],
       f"SELECT Letter, {date_of('DoBDD', 'DoBMD', birth_year('DoBYD'))} AS DoB FROM ident_v")
select("expand_birth_year", ["ident_v"], f"""SELECT Letter, {birth_year('DoBYD')} AS literal,
  CASE WHEN DoBYD > 1000 THEN DoBYD WHEN DoBYD < 30 THEN DoBYD + 2000
       WHEN DoBYD < 100 THEN DoBYD + 1900 END AS pivot30 FROM ident_v""")
select("expand_visit_year", ["ident_v"], f"""SELECT Letter, {visit_year('ClinicYD')} AS literal,
  CASE WHEN ClinicYD > 1000 THEN ClinicYD WHEN ClinicYD <= 25 THEN ClinicYD + 2000
       ELSE ClinicYD + 1900 END AS pivot25 FROM ident_v""")
select("normalise_ids", ["ident_v"], f"""SELECT Letter, {clean_id('NHS_No')} AS NHS_No,
  replace(Hosp_No, ' ', '') AS Hosp_No, upper(Surname) AS Surname FROM ident_v""")
select("gender_code", ["ident_v"], f"SELECT Letter, Gender, {GENDER} AS GENDER_CD FROM ident_v")

# --- record dates --------------------------------------------------------------------------

DATED = f"""dated AS (SELECT *, {text_date('CASE WHEN Clinic_Date IS NOT NULL THEN Clinic_Date ELSE LetDate END')}
  AS DATEREC FROM dates_v)"""

ANNOTATED = f"""annotated AS (
  SELECT Letter, Start, "End", CUI, Certainty, replace(Hosp_No, ' ', '') AS Hosp_No,
    {clean_id('NHS_No')} AS NHS_No, PostCode, Gender, Address, FirstName, Surname,
    {date_of('DoBDD', 'DoBMD', birth_year('DoBYD'))} AS DoB,
    {date_of('ClinicDD', 'ClinicMD', visit_year('ClinicYD'))} AS Clinic_Date,
    {date_of('LetDD', 'LetMD', visit_year('LetYD'))} AS Let_Date
  FROM ident_v)"""

select("record_date", ["dates_v"], "SELECT * FROM dated", DATED)
select("normalise_annotations", ["ident_v"],
       "SELECT *, coalesce(Clinic_Date, Let_Date) AS DATEREC FROM annotated", ANNOTATED)
select("letter_dates", ["dates_v", "letters_v"], """
SELECT d.*, l.DOC FROM dates_v d LEFT JOIN letters_v l ON d.LETTER = l.LETTER""")
select("attach_record_date", ["presc_v", "dates_v"], """
SELECT p.LETTER, p."START", p."END", p.CUI, p.DOSE, d.DATEREC
FROM presc_v p LEFT JOIN dated d ON p.LETTER = d.LETTER""", DATED)
select("attach_record_date_factored", ["presc_v", "dates_v"], """
SELECT count(*) FILTER (p.k IS NOT NULL)::BIGINT AS known,
  (SELECT count(*) FROM presc_v WHERE LETTER % 3 = 0)::BIGINT AS left,
  (SELECT count(*) FROM dated WHERE LETTER % 3 = 0)::BIGINT AS right, count(*)::BIGINT AS total
FROM (SELECT CASE WHEN LETTER % 3 <> 0 THEN LETTER END AS k FROM presc_v) p
LEFT JOIN (SELECT CASE WHEN LETTER % 3 <> 0 THEN LETTER END AS k FROM dated) d ON p.k IS NOT DISTINCT FROM d.k""", DATED)
select("dated_prescriptions_by_doc", ["presc_v", "dates_v", "letters_v"], """
SELECT p.SYSTEM_ID, d.DATEREC, l.DOC, p."START", p."END", p.CUI, p.NAME, p.DOSE, p.UNIT, p.FREQUENCY
FROM presc_v p LEFT JOIN dated d ON p.LETTER = d.LETTER LEFT JOIN letters_v l ON d.LETTER = l.LETTER""",
       DATED)
select("dated_reports", ["sf_v", "dates_v"], """
SELECT s.SYSTEM_ID, d.DATEREC, s.LETTER, 0 AS Start, 5 AS "End", s.CUI, s.FreqChange, s.NofS,
  CAST(NULL AS DOUBLE) AS LNofS, s.UNofS, s.TP, s.NofTP, s.LNofTP, CAST(NULL AS DOUBLE) AS UNofTP,
  s.Sin_Dur, s.YD, s.MD, s.DD, s.PinT
FROM sf_v s LEFT JOIN dated d ON s.LETTER = d.LETTER""", DATED)
select("letters_without_date", ["letters_v", "dates_v"],
       "SELECT * FROM letters_v WHERE LETTER NOT IN (SELECT LETTER FROM dates_v)")
select("letters_without_date_by_doc", ["letters_v", "dates_v"], """
SELECT * FROM letters_v WHERE DOC NOT IN (
  SELECT l.DOC FROM dates_v d JOIN letters_v l ON d.LETTER = l.LETTER)""")
select("distinct_letters", ["presc_v"], "SELECT DISTINCT LETTER FROM presc_v")

# --- prescriptions -------------------------------------------------------------------------

ROW = 'LETTER, "START", "END", CUI, NAME, DOSE, UNIT, FREQUENCY'
LETTER_WINDOW = """WINDOW w AS (PARTITION BY LETTER ORDER BY "START" NULLS LAST, CUI NULLS LAST,
  "END" NULLS LAST, FREQUENCY NULLS LAST, DOSE NULLS LAST, UNIT NULLS LAST, NAME NULLS LAST)"""

QUANTITY = """quantity AS (SELECT *, CASE WHEN UNIT = 'mg' THEN DOSE WHEN UNIT = 'g' THEN DOSE * 1000 END
  AS Quantity_mg FROM presc_v)"""
FLAG = f"""flag AS (SELECT *, CASE
    WHEN "START" = lag("START") OVER w AND "START" IS DISTINCT FROM lag("START", 2) OVER w
      AND CUI = lag(CUI) OVER w AND FREQUENCY = 1 AND lag(FREQUENCY) OVER w = 1 THEN '2nd'
    WHEN "START" = lag("START") OVER w AND "START" = lag("START", 2) OVER w AND CUI = lag(CUI) OVER w
      AND CUI = lag(CUI, 2) OVER w AND FREQUENCY = 1 AND lag(FREQUENCY, 2) OVER w = 1 THEN '3rd'
    WHEN "START" = lag("START", 2) OVER w AND "START" <> lag("START") OVER w
      AND FREQUENCY = 1 AND lag(FREQUENCY, 2) OVER w = 1 THEN '2nd' END AS AnotherDose
  FROM quantity {LETTER_WINDOW})"""


def parts(rule):
    second = ("lag(Quantity_mg) OVER w" if rule == "previous" else """CASE
      WHEN "START" = lag("START") OVER w AND CUI = lag(CUI) OVER w THEN lag(Quantity_mg) OVER w
      WHEN "START" = lag("START", 2) OVER w AND CUI = lag(CUI, 2) OVER w
      THEN lag(Quantity_mg, 2) OVER w END""")
    return f"""parts AS (SELECT *, CASE WHEN AnotherDose = '2nd' THEN {second} END AS Q2ndDose,
    CASE WHEN AnotherDose = '2nd' AND lead(AnotherDose) OVER w = '3rd' THEN lead(Quantity_mg) OVER w END
      AS Q3rdDose FROM flag {LETTER_WINDOW})"""


CODES = ", ".join(repr(c) for c in q.NO_FREQUENCY_CODES)
DAILY = f"""daily AS (SELECT *, CASE
    WHEN FREQUENCY > 1 THEN Quantity_mg * FREQUENCY
    WHEN AnotherDose = '2nd' AND Q3rdDose IS NOT NULL THEN Quantity_mg + Q2ndDose + Q3rdDose
    WHEN AnotherDose = '2nd' THEN Quantity_mg + Q2ndDose
    WHEN AnotherDose IS NULL AND Q2ndDose IS NULL AND Q3rdDose IS NULL
      AND "START" IS DISTINCT FROM lead("START") OVER w
      AND "START" IS DISTINCT FROM lead("START", 2) OVER w AND FREQUENCY = 1 THEN Quantity_mg
    WHEN FREQUENCY IS NULL AND AnotherDose IS NULL AND CUI IN ({CODES}) THEN Quantity_mg END AS DailyDose
  FROM parts {LETTER_WINDOW})"""


def doses(rule="matched"):
    return QUANTITY, FLAG, parts(rule), DAILY


PREF = "CASE " + " ".join(f"WHEN {col} = '{value}' THEN '{generic}'"
                          for generic, col, value in q.NAME_MAP) + " END AS PREF"
NAMED = f"named AS (SELECT *, {PREF} FROM daily)"
MAXED = """maxed AS (SELECT SYSTEM_ID, LETTER, DATEREC, CUI, PREF, max(DailyDose) AS DailyDose FROM named
  WHERE SYSTEM_ID IS NOT NULL AND LETTER IS NOT NULL AND DATEREC IS NOT NULL AND CUI IS NOT NULL
    AND PREF IS NOT NULL AND DailyDose IS NOT NULL GROUP BY ALL)"""
RATIOS = f"""ratios AS (SELECT m.*, t.TopDose,
    CAST(round_even(CAST({ratio('m.DailyDose', 't.TopDose')} AS DECIMAL(38, 12)), 2) AS DOUBLE) AS DailyRate
  FROM maxed m LEFT JOIN (VALUES {rows(q.TOP_DOSES)}) t(ASM, TopDose) ON m.PREF = t.ASM)"""
TO_RATIOS = (*doses(), NAMED, MAXED, RATIOS)

select("quantity_mg", ["presc_v"], f"SELECT {ROW}, Quantity_mg FROM quantity", QUANTITY)
select("split_dose_flag", ["presc_v"], f"SELECT {ROW}, AnotherDose FROM flag", QUANTITY, FLAG)
select("split_dose_qty", ["presc_v"],
       f"SELECT {ROW}, Quantity_mg, AnotherDose, Q2ndDose, Q3rdDose FROM parts",
       QUANTITY, FLAG, parts("matched"))
select("split_dose_qty_previous", ["presc_v"], f"SELECT {ROW}, Q2ndDose, Q3rdDose FROM parts",
       QUANTITY, FLAG, parts("previous"))
select("daily_dose", ["presc_v"], f"SELECT {ROW}, DailyDose FROM daily", *doses())
select("generic_name_medicines", ["presc_v"], f"""
SELECT p.* EXCLUDE (SYSTEM_ID, DOC, DATEREC), arg_min(m.generic, m.priority) AS PREF
FROM (SELECT * REPLACE (
    [{', '.join(map(repr, q.MEDICINE_NAMES))}][CAST(LETTER % {len(q.MEDICINE_NAMES)} AS INT) + 1] AS NAME,
    [{', '.join(map(repr, q.MEDICINE_CODES))}][CAST(SYSTEM_ID % {len(q.MEDICINE_CODES)} AS INT) + 1] AS CUI),
    row_number() OVER () AS r FROM presc_v) p
  LEFT JOIN (VALUES {rows([(*m, i) for i, m in enumerate(q.MEDICINES)])}) m(generic, col, value, priority)
  ON (m.col = 'NAME' AND m.value = p.NAME) OR (m.col = 'CUI' AND m.value = p.CUI)
GROUP BY ALL""".replace("p.* EXCLUDE (SYSTEM_ID, DOC, DATEREC)", f"{ROW}").replace(
    "GROUP BY ALL", f"GROUP BY r, {ROW}"))
for name in ("generic_name", "generic_name_table"):
    select(name, ["presc_v"], f"SELECT {ROW}, {PREF} FROM presc_v")
select("daily_dose_clean", ["presc_v"], """
SELECT DISTINCT SYSTEM_ID, LETTER, DATEREC, CUI, PREF, DailyDose FROM named
WHERE DailyDose IS NOT NULL AND PREF IS NOT NULL""", *doses(), NAMED)
select("daily_dose_clean_by_name", ["presc_v"], """
SELECT DISTINCT SYSTEM_ID, DATEREC, DOC, CUI, NAME, DailyDose FROM daily
WHERE DailyDose IS NOT NULL AND NAME IS NOT NULL""", *doses("previous"))
select("max_daily_dose", ["presc_v"], "SELECT * FROM maxed", *doses(), NAMED, MAXED)
select("max_daily_dose_by_person", ["presc_v"], """
SELECT SYSTEM_ID, DATEREC, CUI, PREF, max(DailyDose) AS DailyDose FROM named
WHERE PREF IS NOT NULL AND DailyDose IS NOT NULL AND DATEREC IS NOT NULL GROUP BY ALL""",
       *doses(), NAMED)
select("max_dose_row", ["presc_v"], """
SELECT SYSTEM_ID, DATEREC, DOC, CUI, NAME, DailyDose FROM daily
WHERE DailyDose IS NOT NULL AND NAME IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY SYSTEM_ID, DATEREC, DOC, CUI ORDER BY DailyDose DESC, NAME) = 1""",
       *doses("previous"))
select("dose_ratio", ["presc_v"], "SELECT * FROM ratios", *TO_RATIOS)
select("rows_per_person", ["presc_v"],
       "SELECT SYSTEM_ID, CAST(count(*) AS BIGINT) AS n FROM ratios GROUP BY SYSTEM_ID", *TO_RATIOS)

# --- seizure frequency ---------------------------------------------------------------------

PERSON_WINDOW = """WINDOW w AS (PARTITION BY SYSTEM_ID ORDER BY DATEREC NULLS LAST, CUI NULLS LAST, LETTER)"""

COUNT = {
    "basic": "CASE WHEN NofS IS NOT NULL THEN NofS WHEN UNofS > 0 THEN UNofS END",
    "expanded": """CASE
      WHEN (Sin_Dur = 'Since' OR Sin_Dur IS NULL) AND NofS IS NOT NULL THEN NofS
      WHEN (Sin_Dur = 'Since' OR Sin_Dur IS NULL) AND UNofS > 0 THEN UNofS
      WHEN Sin_Dur = 'During' AND TP IS DISTINCT FROM 'Week' AND NofS IS NOT NULL THEN NofS
      WHEN Sin_Dur = 'During' AND TP IS DISTINCT FROM 'Week' AND UNofS > 0 THEN UNofS
      WHEN Sin_Dur = 'During' AND TP = 'Week' AND MD IS NOT NULL AND NofS IS NOT NULL
        THEN CAST(4.3 AS DOUBLE) * NofS
      WHEN Sin_Dur = 'During' AND TP = 'Week' AND MD IS NOT NULL AND UNofS > 0
        THEN CAST(4.3 AS DOUBLE) * UNofS END""",
}
GUESSED_YEAR = "CASE WHEN MD < month(DATEREC) THEN year(DATEREC) ELSE year(DATEREC) - 1 END"
EVENT = f"""CASE
      WHEN YD IS NOT NULL AND MD IS NOT NULL AND DD IS NOT NULL THEN {date_of('DD', 'MD', 'YD')}
      WHEN YD IS NOT NULL AND MD IS NOT NULL THEN {date_of(1, 'MD', 'YD')}
      WHEN YD IS NOT NULL AND DD IS NULL THEN {date_of(1, 1, 'YD')}
      WHEN YD IS NULL AND MD IS NOT NULL AND DD IS NULL THEN {date_of(1, 'MD', GUESSED_YEAR)}
      WHEN YD IS NULL AND MD IS NOT NULL THEN {date_of('DD', 'MD', GUESSED_YEAR)} END"""
EVENT2 = """CASE WHEN YD IS NULL AND MD IS NULL AND DD IS NULL AND PinT = 'Last_Month' THEN DATEREC - 30
      WHEN YD IS NULL AND MD IS NULL AND DD IS NULL AND PinT = 'Last_Year' THEN DATEREC - 365 END"""


def look_back(value, guard=""):
    arms = " ".join(
        f"WHEN CUI = lag(CUI, {k}) OVER w AND DATEREC > lag(DATEREC, {k}) OVER w {guard} "
        f"THEN lag({value}, {k}) OVER w" for k in range(1, 7))
    return f"CASE {arms} END"


def sf_chain(variant):
    expanded = variant == "expanded"
    stated = (f"CASE WHEN Sin_Dur IS NULL THEN {ratio('NumS', 'TotalTPDays')} END" if expanded
              else ratio(ratio("NumS", "NTP"), "Days"))
    clinic = "PrevRecDate" if expanded else "PrevRecCUI"
    more = ("""WHEN PinT = 'This_Year' THEN DATEREC - DATEREC_Year
      WHEN FreqChange = 'Same' THEN DATEREC - PrevRecCUI""" if expanded else "")
    since = ratio("NumS", "DaysDiff")
    if expanded:
        since = f"""CASE WHEN Sin_Dur IS NOT NULL THEN {since} WHEN PinT <> 'LastClinic' THEN {since}
          WHEN PinT = 'LastClinic' AND DaysDiff < 183 THEN {since} END"""
    same = "DaysDiff < 183" if expanded else "DATEREC - PrevRecCUI > 182"
    return (
        f"""reported AS (SELECT *, {COUNT[variant]} AS NumS,
    CASE WHEN NofTP > 0 THEN NofTP WHEN NofTP IS NULL AND LNofTP > 0 THEN LNofTP END AS NTP,
    CASE TP WHEN 'Day' THEN 1 WHEN 'Week' THEN 7 WHEN 'Month' THEN 30 WHEN 'Year' THEN 365 END AS Days,
    {EVENT} AS EventDate, {EVENT2} AS EventDate2,
    CAST(date_trunc('year', DATEREC) AS DATE) AS DATEREC_Year FROM sf_v)""",
        "periods AS (SELECT *, Days * NTP AS TotalTPDays FROM reported)",
        f"""looked AS (SELECT *, {stated} AS DailyRate,
    CASE WHEN DATEREC > lag(DATEREC) OVER w THEN lag(DATEREC) OVER w END AS PrevRecDate,
    {look_back('DATEREC')} AS PrevRecCUI FROM periods {PERSON_WINDOW})""",
        f"""gaps AS (SELECT *, CAST(CASE WHEN EventDate IS NOT NULL THEN DATEREC - EventDate
      WHEN PinT = 'LastClinic' AND {clinic} IS NOT NULL THEN DATEREC - {clinic}
      WHEN PinT IN ('Last_Month', 'Last_Year') THEN DATEREC - EventDate2
      {more} END AS INT) AS DaysDiff FROM looked)""",
        f"gap_rates AS (SELECT *, {since} AS DailyRate2 FROM gaps)",
        """rates AS (SELECT *, CASE WHEN DailyRate IS NOT NULL THEN DailyRate ELSE DailyRate2 END AS DailyRateF,
    CASE WHEN NumS = 0 AND Days IS NOT NULL THEN TotalTPDays WHEN NumS = 0 THEN DaysDiff END AS SeizureFree
    FROM gap_rates)""",
        f"""carried AS (SELECT *, {look_back('DailyRateF', 'AND DailyRateF IS NULL')} AS PrevCUIFreq
    FROM rates {PERSON_WINDOW})""",
        f"""same AS (SELECT *, CASE WHEN FreqChange = 'Same' AND {same} THEN PrevCUIFreq END
    AS PrevRateCUI_Same6m FROM carried)""",
        """final AS (SELECT *, coalesce(DailyRateF, PrevRateCUI_Same6m) AS DailyRateSF FROM same)""",
        """scored AS (SELECT *, CASE WHEN SeizureFree < 7 THEN 6
      WHEN SeizureFree > 6 AND SeizureFree < 30 THEN 5 WHEN SeizureFree > 29 AND SeizureFree < 182 THEN 4
      WHEN SeizureFree > 181 AND SeizureFree < 365 THEN 3
      WHEN SeizureFree > 364 AND SeizureFree < 730 THEN 2 WHEN SeizureFree > 729 THEN 1
      WHEN DailyRateSF > 1 THEN 7 WHEN DailyRateSF > 0.2857143 AND DailyRateSF < 2 THEN 6
      WHEN DailyRateSF > 0.0657534 AND DailyRateSF < 0.2857144 THEN 5
      WHEN DailyRateSF > 0.0109589 AND DailyRateSF < 0.0657535 THEN 4
      WHEN DailyRateSF > 0.0054795 AND DailyRateSF < 0.0109590 THEN 3
      WHEN DailyRateSF > 0.0027322 AND DailyRateSF < 0.0054796 THEN 2
      WHEN DailyRateSF < 0.0027321 THEN 1 END AS FreqSeverity FROM final)""")


def sf(name, columns, variants=("expanded", "basic")):
    for variant in variants:
        key = name if variant == "expanded" else f"{name}_{variant}"
        select(key, ["sf_v"], f"SELECT {columns} FROM scored", *sf_chain(variant))


sf("event_count", "LETTER, NumS")
sf("event_date", "LETTER, DATEREC, EventDate, EventDate2", ["expanded"])
sf("stated_rate", "LETTER, NTP, Days, TotalTPDays, DailyRate")
sf("prev_record", "LETTER, SYSTEM_ID, DATEREC, PrevRecDate", ["expanded"])
sf("prev_same_code_date", "LETTER, SYSTEM_ID, DATEREC, CUI, PrevRecCUI", ["expanded"])
sf("days_diff", "LETTER, DATEREC_Year, DaysDiff")
sf("since_rate", "LETTER, DailyRate2, DailyRateF")
sf("seizure_free", "LETTER, NumS, SeizureFree")
sf("prev_same_code_rate", "LETTER, DailyRateF, PrevCUIFreq")
sf("final_rate", "LETTER, PrevRateCUI_Same6m, DailyRateSF")
INPUT = """SYSTEM_ID, LETTER, DATEREC, CUI, FreqChange, NofS, UNofS, TP, NofTP, LNofTP, Sin_Dur, YD, MD,
  DD, PinT"""
sf("severity", f"""{INPUT}, EventDate, EventDate2, DATEREC_Year, Days, TotalTPDays, DaysDiff,
  SeizureFree, DailyRateSF, FreqSeverity""", ["expanded"])
sf("severity", f"""{INPUT}, EventDate, EventDate2, Days, DaysDiff, SeizureFree, DailyRateSF,
  FreqSeverity""", ["basic"])
select("prev_record_distinct_dates", ["sf_v"], """
SELECT LETTER, SYSTEM_ID, DATEREC, (SELECT max(e.DATEREC) FROM sf_v e
  WHERE e.SYSTEM_ID = s.SYSTEM_ID AND e.DATEREC < s.DATEREC) AS PrevRecDate FROM sf_v s""")

BY_CODE = """by_code AS (SELECT SYSTEM_ID, DATEREC, LETTER, CUI, FreqSeverity FROM scored
  WHERE FreqSeverity IS NOT NULL)"""
GROUPED = f"""grouped AS (SELECT DISTINCT b.*, g.Seizures FROM by_code b
  JOIN (VALUES {rows(q.GROUPS)}) g(CUI, Seizures) ON b.CUI = g.CUI)"""
NORMED = """normed AS (SELECT *, CAST(FreqSeverity - (SELECT min(FreqSeverity) FROM grouped) AS DOUBLE)
  / ((SELECT max(FreqSeverity) FROM grouped) - (SELECT min(FreqSeverity) FROM grouped)) AS NV FROM grouped)"""
TO_CODE = (*sf_chain("expanded"), BY_CODE)

select("severity_by_code", ["sf_v"], "SELECT * FROM by_code", *TO_CODE)
select("severity_grouped", ["sf_v"], "SELECT * FROM grouped", *TO_CODE, GROUPED)
select("rate_subsets", ["sf_v"], """
SELECT LETTER, 'free' AS subset FROM scored WHERE SeizureFree IS NOT NULL
UNION ALL SELECT LETTER, 'active' AS subset FROM scored WHERE DailyRateSF > 0""",
       *sf_chain("expanded"))
select("max_severity_by_date", ["sf_v"], """
SELECT * FROM by_code QUALIFY FreqSeverity = max(FreqSeverity) OVER (PARTITION BY DATEREC)""", *TO_CODE)
select("max_severity_by_person_date", ["sf_v"], """
SELECT * FROM by_code
QUALIFY FreqSeverity = max(FreqSeverity) OVER (PARTITION BY SYSTEM_ID, DATEREC)""", *TO_CODE)
select("severity_norm", ["sf_v"], "SELECT * FROM normed", *TO_CODE, GROUPED, NORMED)
select("person_timeline", ["presc_v", "sf_v"], """
SELECT coalesce(d.SYSTEM_ID, s.SYSTEM_ID) AS SYSTEM_ID, coalesce(d.LETTER, s.LETTER) AS LETTER,
  coalesce(d.DATEREC, s.DATEREC) AS DATEREC, coalesce(d.CUI, s.CUI) AS CUI,
  coalesce(d.PREF, s.Seizures) AS Category, coalesce(d.DailyRate, s.NV) AS NV, s.FreqSeverity
FROM (SELECT DISTINCT * FROM ratios) d FULL JOIN (SELECT DISTINCT * FROM normed) s
  ON d.SYSTEM_ID IS NOT DISTINCT FROM s.SYSTEM_ID AND d.LETTER IS NOT DISTINCT FROM s.LETTER
  AND d.DATEREC IS NOT DISTINCT FROM s.DATEREC AND d.CUI IS NOT DISTINCT FROM s.CUI
  AND d.PREF IS NOT DISTINCT FROM s.Seizures AND d.DailyRate IS NOT DISTINCT FROM s.NV""",
       *TO_RATIOS, *TO_CODE, GROUPED, NORMED)

# --- diagnosis -----------------------------------------------------------------------------

CLASSED = """classed AS (SELECT *, CASE
    WHEN Certainty = 4 AND DiagCategory <> 'SingleSeizure' THEN 'Epilepsy'
    WHEN Certainty = 5 AND DiagCategory <> 'SingleSeizure' THEN 'Epilepsy'
    WHEN DiagCategory = 'SingleSeizure' THEN 'NO' END AS Diag FROM dx_v)"""
SPECIFIC = f"""specific AS (SELECT Letter, Start, Certainty, DiagCategory, CUI, {clean_id('NHS_No')} AS NHS_No,
    Diag FROM classed WHERE DiagCategory = 'Epilepsy'
    AND CUI NOT IN ('C0014544', 'C1096063', 'C1406659', 'C0014557', 'C0393720'))"""


def dx(name, text, *more):
    select(name, ["dx_v"], text, CLASSED, *more)


dx("diagnosis_class", "SELECT Letter, Start, Certainty, DiagCategory, Diag FROM classed")
dx("annotation_diagnosis", "SELECT DISTINCT Letter, Start, Diag, NHS_No FROM classed")
dx("letter_diagnosis", "SELECT DISTINCT Letter, Diag FROM classed")
dx("letter_epilepsy", """
SELECT Letter, CASE WHEN bool_or(coalesce(Diag = 'Epilepsy', FALSE)) THEN 'Epilepsy' END AS Epilepsy
FROM classed GROUP BY Letter""")
dx("people_with_epilepsy", f"""
SELECT DISTINCT {clean_id('NHS_No')} AS NHS_No FROM classed
WHERE Diag = 'Epilepsy' AND DiagCategory = 'Epilepsy' AND NHS_No IS NOT NULL""")
dx("specific_type", "SELECT * FROM specific", SPECIFIC)
dx("people_with_specific_type", "SELECT DISTINCT NHS_No FROM specific WHERE NHS_No IS NOT NULL",
   SPECIFIC)
dx("type_counts", f"""
SELECT t.EpilepsyType, CAST(count(DISTINCT s.NHS_No) AS BIGINT) AS people
FROM specific s JOIN (VALUES {rows(q.TYPES)}) t(CUI, EpilepsyType) ON s.CUI = t.CUI
GROUP BY t.EpilepsyType""", SPECIFIC)

# --- identity ------------------------------------------------------------------------------

IND = f"""ind AS (SELECT DISTINCT NHS_No, upper(Surname) AS Surname, FirstName, DoB, Gender, PostCode, Address
  FROM annotated)"""
SAME_PERSON = " AND ".join(f"a.{x} IS NOT DISTINCT FROM b.{y}" for x, y in (
    ("Surname", "Surname"), ("FirstName", "FirstName"), ("DoB", "DoB"), ("GENDER_CD", "GENDER_CD"),
    ("PostCode", "PostCode")))
# Every address row of an identity meets every known number of it, as written.
JOINED = f"""coded AS (SELECT *, {GENDER} AS GENDER_CD FROM ind),
known AS (SELECT DISTINCT NHS_No AS NHS1, Surname, FirstName, DoB, GENDER_CD, PostCode FROM coded
  WHERE NHS_No IS NOT NULL AND DoB IS NOT NULL AND Surname IS NOT NULL),
firsts AS (SELECT b.NHS1 AS NHS_NUMBER, a.Surname AS SURNAME, a.FirstName AS FORENAME,
    a.DoB AS DATE_OF_BIRTH, a.GENDER_CD, a.PostCode AS POSTCODE, min(a.Address) AS first_address
  FROM coded a LEFT JOIN known b ON {SAME_PERSON}
  WHERE a.DoB IS NOT NULL AND a.Surname IS NOT NULL GROUP BY ALL),
plain AS (SELECT * EXCLUDE (first_address), replace(first_address, ',', '') AS ADDRESS_1 FROM firsts)"""
FILE_COLUMNS = ("NHS_NUMBER", "SURNAME", "FORENAME", "DATE_OF_BIRTH", "GENDER_CD", "POSTCODE",
                "ADDRESS_1")
FILE = f"""file AS (SELECT *, row_number() OVER (ORDER BY {', '.join(
    c + ' NULLS LAST' for c in FILE_COLUMNS)}) AS SYSTEM_ID,
    CAST('{q.AS_OF}' AS DATE) AS CREATE_DATE FROM plain)"""
MATCHED = f"""people AS (SELECT * REPLACE (upper(Surname) AS Surname), {GENDER} AS GENDER_CD FROM annotated),
matched AS (SELECT a.*, b.NHS_NUMBER, b.ADDRESS_1, b.SYSTEM_ID, b.CREATE_DATE
  FROM people a LEFT JOIN file b ON a.Surname IS NOT DISTINCT FROM b.SURNAME
    AND a.FirstName IS NOT DISTINCT FROM b.FORENAME AND a.DoB IS NOT DISTINCT FROM b.DATE_OF_BIRTH
    AND a.GENDER_CD IS NOT DISTINCT FROM b.GENDER_CD AND a.PostCode IS NOT DISTINCT FROM b.POSTCODE)"""

select("people_count", ["ident_v", "dx_v"], f"""
SELECT CAST(count(DISTINCT NHS_No) AS BIGINT) AS people FROM (
  SELECT {clean_id('NHS_No')} AS NHS_No FROM ident_v UNION SELECT {clean_id('NHS_No')} FROM dx_v)""")
select("people_count_three", ["ident_v", "dx_v", "trusted_v"], f"""
SELECT CAST(count(DISTINCT NHS_No) AS BIGINT) AS people FROM (
  SELECT {clean_id('NHS_No')} AS NHS_No FROM ident_v UNION SELECT {clean_id('NHS_No')} FROM dx_v
  UNION SELECT {clean_id('NHS_NUMBER')} FROM trusted_v)""")
select("individuals", ["ident_v"], "SELECT * FROM ind", ANNOTATED, IND)
select("individuals_known", ["ident_v"], """
SELECT DISTINCT NHS_No AS NHS1, Surname, FirstName, DoB, Gender, PostCode FROM ind
WHERE NHS_No IS NOT NULL""", ANNOTATED, IND)
select("identity_file", ["ident_v"], "SELECT * FROM file", ANNOTATED, IND, JOINED, FILE)
select("identity_ids", ["ident_v"], """
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) AS BIGINT) AS ids, CAST(1 AS BIGINT) AS first,
  CAST(count(*) AS BIGINT) AS last FROM plain""", ANNOTATED, IND, JOINED)
select("linked_kinds", ["ident_v"], f"""
SELECT [{', '.join(repr(k) for k in KINDS)}][CAST(Letter % {len(KINDS)} AS INT) + 1] AS kind,
  Letter, NHS_NUMBER, ADDRESS_1, SYSTEM_ID FROM matched""", ANNOTATED, IND, JOINED, FILE, MATCHED)
select("match_identity", ["ident_v"], """
SELECT Letter, NHS_No, Surname, GENDER_CD, NHS_NUMBER, ADDRESS_1, SYSTEM_ID, CREATE_DATE FROM matched""",
       ANNOTATED, IND, JOINED, FILE, MATCHED)
select("code_cohort", ["ident_v"], """
SELECT DISTINCT SYSTEM_ID FROM matched
WHERE (CUI = 'C3495874' OR CUI = 'C1142430' OR CUI = 'C0349245') AND Certainty > 3""",
       ANNOTATED, IND, JOINED, FILE, MATCHED)

# --- validation ----------------------------------------------------------------------------

EXTRACTED = f"""extracted AS (SELECT CAST(substr(Hosp_No, 2) AS BIGINT) AS SYSTEM_ID, DoB AS DATE_OF_BIRTH,
    NHS_No AS NHS_NUMBER, CASE WHEN Gender IS NOT NULL THEN {GENDER} END AS GENDER_CD,
    PostCode AS POSTCODE FROM annotated)"""


def check(name, text):
    """Register a validation query for each checked value ({c}: column, {t}: trusted column)."""
    for short, (column, trusted) in q.CHECKED.items():
        one = f"a AS (SELECT SYSTEM_ID, {column} FROM extracted WHERE {column} IS NOT NULL)"
        select(name if short == "dob" else f"{name}_{short}", ["ident_v", "trusted_v"],
               text.format(c=column, t=trusted), ANNOTATED, EXTRACTED, one)


check("value_match", """
SELECT a.SYSTEM_ID, a.{c}, max(b.{t}) AS TRUSTED_{c}, CAST(count(b.{t}) AS BIGINT) AS n_trusted
FROM (SELECT *, row_number() OVER () AS r FROM a) a LEFT JOIN trusted_v b ON a.{c} = b.{t}
GROUP BY a.r, a.SYSTEM_ID, a.{c}""")
check("value_links", """
SELECT coalesce(x.v, y.v) AS value, coalesce(x.n, 0) AS n_extracted, coalesce(y.n, 0) AS n_trusted, coalesce(z.n, 0) AS links
FROM (SELECT {c} AS v, count(*)::BIGINT AS n FROM a GROUP BY 1) x
FULL JOIN (SELECT {t} AS v, count(*)::BIGINT AS n FROM trusted_v WHERE {t} IS NOT NULL GROUP BY 1) y ON x.v = y.v
LEFT JOIN (SELECT a.{c} AS v, count(*)::BIGINT AS n FROM a JOIN trusted_v b ON a.{c} = b.{t} GROUP BY 1) z
  ON z.v = coalesce(x.v, y.v)""")
check("value_pairs", """
SELECT a.SYSTEM_ID, a.{c}, b.{t} AS TRUSTED_{c} FROM a LEFT JOIN trusted_v b ON a.{c} = b.{t}""")
for _short in ("gender", "postcode"):  # millions of pairs
    del ORACLES[f"value_pairs_{_short}"]
BY_ID = """
SELECT a.SYSTEM_ID, min(a.{c}) AS {c}, bool_or(b.{t} IS NOT NULL) AS matched
FROM a LEFT JOIN trusted_v b ON a.{c} = b.{t} GROUP BY a.SYSTEM_ID"""
check("value_match_by_id", BY_ID)
check("annotations_per_id",
      "SELECT SYSTEM_ID, CAST(count(SYSTEM_ID) AS BIGINT) AS n FROM a GROUP BY SYSTEM_ID")
check("missed_ids", """
SELECT SYSTEM_ID FROM trusted_v WHERE SYSTEM_ID NOT IN (SELECT SYSTEM_ID FROM a)""")
check("value_overlap", """
SELECT CAST(count(*) FILTER (y IS NULL) AS BIGINT) AS only_a,
  CAST(count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS BIGINT) AS both,
  CAST(count(*) FILTER (x IS NULL) AS BIGINT) AS only_b
FROM (SELECT DISTINCT {c} AS x FROM a)
  FULL JOIN (SELECT DISTINCT {t} AS y FROM trusted_v WHERE {t} IS NOT NULL) ON x = y""")
NUMBERS = "a AS (SELECT SYSTEM_ID, NHS_NUMBER FROM extracted WHERE NHS_NUMBER IS NOT NULL)"
select("value_membership", ["ident_v", "trusted_v"], """
SELECT *, NHS_NUMBER IN (SELECT NHS_NUMBER FROM trusted_v) AS matched FROM a""",
       ANNOTATED, EXTRACTED, NUMBERS)
select("matched_values", ["ident_v", "trusted_v"], """
SELECT NHS_NUMBER FROM a WHERE NHS_NUMBER IN (SELECT NHS_NUMBER FROM trusted_v)""",
       ANNOTATED, EXTRACTED, NUMBERS)
for short, (column, trusted) in q.CHECKED.items():
    one = f"a AS (SELECT SYSTEM_ID, {column} FROM extracted WHERE {column} IS NOT NULL)"
    for name, text in {
            "sql_count": "SELECT SYSTEM_ID, CAST(count(SYSTEM_ID) AS BIGINT) AS n FROM a GROUP BY SYSTEM_ID",
            "sql_match": BY_ID.format(c=column, t=trusted),
            "sql_missed": """SELECT SYSTEM_ID FROM trusted_v
              WHERE SYSTEM_ID NOT IN (SELECT SYSTEM_ID FROM a)"""}.items():
        select(name if short == "postcode" else f"{name}_{short}", ["ident_v", "trusted_v"], text,
               ANNOTATED, EXTRACTED, one)

BOTH = """both_dates AS (SELECT coalesce(c.LETTER, l.LETTER) AS LETTER, c.Clinic_Date, l.LetDate
  FROM (SELECT * FROM dates_v WHERE Clinic_Date IS NOT NULL) c
  FULL JOIN (SELECT * FROM dates_v WHERE LetDate IS NOT NULL) l ON c.LETTER = l.LETTER)"""
LISTED = """listed AS (SELECT coalesce(b.LETTER, l.LETTER) AS LETTER, b.Clinic_Date, b.LetDate, l.SYSTEM_ID, l.DOC
  FROM both_dates b FULL JOIN letters_v l ON b.LETTER = l.LETTER)"""
select("clinic_letter_full", ["dates_v"], "SELECT * FROM both_dates", BOTH)
select("dates_with_letters", ["dates_v", "letters_v"], "SELECT * FROM listed", BOTH, LISTED)
select("duplicate_docs", ["dates_v", "letters_v"], """
SELECT * FROM listed QUALIFY count(*) OVER (PARTITION BY DOC) > 1""", BOTH, LISTED)
select("sample_dates", ["dates_v"], """
SELECT s.doc_id AS LETTER, d.SYSTEM_ID, d.Clinic_Date, d.LetDate, d.DATEREC
FROM labels s LEFT JOIN dated d ON s.doc_id = d.LETTER""", DATED)
select("without_clinic_date", ["dates_v"], "SELECT * FROM dates_v WHERE Clinic_Date IS NULL")
select("date_order_check", ["dates_v"], f"""
SELECT LETTER, SYSTEM_ID, {text_date('Clinic_Date')} AS Clinic_Date, {text_date('LetDate')} AS LetDate
FROM dates_v WHERE {text_date('Clinic_Date')} > {text_date('LetDate')}""")

# --- the same results by way of ranges -------------------------------------------------------

for _name in ("severity", "severity_basic", "prev_record", "prev_same_code_rate", "split_dose_qty", "daily_dose"):
    ORACLES[f"{_name}_ranged"] = ORACLES[_name]
ORACLES["dates_with_letters_common"] = ORACLES["dates_with_letters"]
