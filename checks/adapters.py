"""Clinical-shaped views over the test tables, in SQL that Spark and DuckDB both read.

`DIV` stands for integer division and double quotes for quoted names; both are
put into the engine's own spelling. Recipes are in FIXTURES.md.
"""

TABLES = ("customer", "lineitem", "orders", "part")

NHS = """CASE WHEN o_orderkey % 4 = 0 THEN NULL
    WHEN o_orderkey % 3 = 0 THEN concat(substr({d}, 1, 3), ' ', substr({d}, 4, 3), ' ', substr({d}, 7, 4))
    WHEN o_orderkey % 3 = 1 THEN concat(substr({d}, 1, 3), '-', substr({d}, 4, 3), '-', substr({d}, 7, 4))
    ELSE {d} END""".format(
    d="cast(4000000000 + o_custkey + CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END AS string)")


def _dmy(date):
    return (f"concat(lpad(cast(day({date}) AS string), 2, '0'), '/', "
            f"lpad(cast(month({date}) AS string), 2, '0'), '/', cast(year({date}) AS string))")


def _two_digit(date):
    return (f"cast(CASE WHEN o_orderkey % 101 = 0 THEN 25 WHEN o_orderkey % 3 = 0 "
            f"THEN year({date}) % 100 ELSE year({date}) END AS int)")


ORDER_DATE = "cast(o_orderdate AS date)"
LETTER_DATE = "date_add(cast(o_orderdate AS date), 14)"
CLEAN_DOB_YEAR = "(CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 60 + 1940 ELSE c_custkey % 100 + 1900 END)"

VIEWS = {
    # Prescriptions: three annotations share a span.
    "presc_v": """
SELECT o_custkey AS SYSTEM_ID, l_orderkey AS LETTER, l_orderkey AS DOC,
  cast(o_orderdate AS date) AS DATEREC,
  cast((l_linenumber - 1) DIV 3 AS int) AS "START", l_linenumber AS "END",
  concat('C', cast((l_orderkey + (l_linenumber - 1) DIV 3) % 7 AS string)) AS CUI,
  p_type AS NAME, l_quantity AS DOSE,
  CASE WHEN l_returnflag IN ('A', 'R') THEN 'mg' WHEN l_partkey % 10 = 0 THEN 'ml' ELSE 'g' END AS UNIT,
  cast(CASE WHEN l_suppkey % 4 = 0 THEN 2 WHEN l_suppkey % 11 = 0 THEN NULL ELSE 1 END AS double) AS FREQUENCY
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey LEFT JOIN {part} ON l_partkey = p_partkey""",
    # Seizure reports: one per order.
    "sf_v": """
SELECT o_custkey AS SYSTEM_ID, o_orderkey AS LETTER,
  CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE cast(o_orderdate AS date) END AS DATEREC,
  concat('C', cast(o_orderkey % 2 AS string)) AS CUI,
  CASE (o_orderkey DIV 11) % 5 WHEN 0 THEN 'Same' WHEN 1 THEN 'Decreased' END AS FreqChange,
  cast(CASE WHEN o_orderkey % 7 IN (0, 1) THEN 0 WHEN o_orderkey % 7 = 2 THEN NULL
       ELSE o_orderkey % 13 END AS double) AS NofS,
  cast(CASE WHEN o_orderkey % 14 = 2 THEN 1 + o_orderkey % 5 END AS double) AS UNofS,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Day' WHEN '2' THEN 'Week' WHEN '3' THEN 'Month'
       WHEN '5' THEN 'Year' END AS TP,
  cast(CASE WHEN (o_orderkey DIV 3) % 3 = 0 THEN NULL ELSE 1 + (o_orderkey DIV 3) % 6 END AS double) AS NofTP,
  cast(CASE WHEN (o_orderkey DIV 3) % 6 = 0 THEN 2 END AS double) AS LNofTP,
  CASE o_orderstatus WHEN 'O' THEN 'Since' WHEN 'F' THEN 'During' END AS Sin_Dur,
  cast(CASE WHEN (o_orderkey DIV 5) % 4 = 0 THEN year(o_orderdate) - (o_orderkey DIV 7) % 3 END AS int) AS YD,
  cast(CASE WHEN (o_orderkey DIV 5) % 4 IN (0, 1) AND o_orderkey % 3 <> 0 THEN 1 + o_orderkey % 12 END AS int) AS MD,
  cast(CASE WHEN (o_orderkey DIV 5) % 4 IN (0, 1) AND o_orderkey % 6 IN (1, 2) THEN 1 + o_orderkey % 31 END AS int) AS DD,
  CASE (o_orderkey DIV 5) % 8 WHEN 2 THEN 'Last_Month' WHEN 3 THEN 'Last_Year' WHEN 6 THEN 'LastClinic'
       WHEN 7 THEN 'This_Year' END AS PinT
FROM {orders}""",
    # Two letters to a document; some undated letters are documents of their own.
    "letters_v": """
SELECT o_orderkey AS LETTER, o_custkey AS SYSTEM_ID,
  CASE WHEN o_orderkey % 70 = 0 THEN -o_orderkey ELSE o_orderkey DIV 2 END AS DOC FROM {orders}""",
    # Dates as text; letters with neither date are not in the table.
    "dates_v": f"""
SELECT o_orderkey AS LETTER, o_custkey AS SYSTEM_ID,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE {_dmy(ORDER_DATE)} END AS Clinic_Date,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 13 = 0
       THEN {_dmy('date_add(cast(o_orderdate AS date), -3)')} ELSE {_dmy(LETTER_DATE)} END AS LetDate
FROM {{orders}} WHERE NOT (o_orderkey % 5 = 0 AND o_orderkey % 7 = 0)""",
    # Text as it may be typed: short days, impossible days, null tokens.
    "typed_v": f"""
SELECT o_orderkey AS LETTER,
  CASE o_orderkey % 8 WHEN 0 THEN ' null' WHEN 1 THEN 'NA' WHEN 2 THEN ''
    WHEN 3 THEN concat('31/02/', cast(year(o_orderdate) AS string))
    WHEN 4 THEN concat(cast(day(o_orderdate) AS string), '/', cast(month(o_orderdate) AS string), '/',
                       cast(year(o_orderdate) AS string))
    ELSE {_dmy(ORDER_DATE)} END AS DateText,
  CASE o_orderkey % 6 WHEN 0 THEN 'NULL' WHEN 1 THEN ' 12 ' WHEN 2 THEN 'many' WHEN 3 THEN '1e2'
    ELSE cast(o_orderkey % 90 AS string) END AS NumberText,
  concat(' ', o_orderpriority, ' ') AS Padded
FROM {{orders}}""",
    # Identity fields of annotations.
    "ident_v": f"""
SELECT o_orderkey AS Letter, cast(o_orderkey % 97 AS int) AS Start, cast(o_orderkey % 97 + 5 AS int) AS "End",
  CASE o_orderkey % 4 WHEN 0 THEN 'C3495874' WHEN 1 THEN 'C1142430' WHEN 2 THEN 'C0349245'
       ELSE 'C0000000' END AS CUI,
  cast(1 + o_orderkey % 5 AS int) AS Certainty,
  cast(1 + c_custkey % 31 AS int) AS DoBDD, cast(1 + c_custkey % 12 AS int) AS DoBMD,
  cast(CASE WHEN c_custkey % 4 = 0 THEN 1940 + c_custkey % 60 ELSE c_custkey % 100 END AS int) AS DoBYD,
  cast(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE day(o_orderdate) END AS int) AS ClinicDD,
  cast(month(o_orderdate) AS int) AS ClinicMD, {_two_digit('o_orderdate')} AS ClinicYD,
  cast(CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE day({LETTER_DATE}) END AS int) AS LetDD,
  cast(month({LETTER_DATE}) AS int) AS LetMD, {_two_digit(LETTER_DATE)} AS LetYD,
  concat('H ', cast(c_custkey AS string)) AS Hosp_No, {NHS} AS NHS_No,
  CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN o_orderkey % 10 = 9
       THEN concat('PC', cast(c_nationkey + 1 AS string))
       ELSE concat('PC', cast(c_nationkey AS string)) END AS PostCode,
  CASE c_custkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' END AS Gender,
  concat(cast(o_orderkey AS string), ', ', c_mktsegment, ' St, ', cast(c_nationkey AS string)) AS Address,
  CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE c_mktsegment END AS FirstName,
  CASE WHEN o_orderkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS Surname
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey""",
    # Diagnosis annotations, three per letter.
    "dx_v": f"""
SELECT o_orderkey DIV 3 AS Letter, cast(o_orderkey % 3 AS int) AS Start,
  cast(1 + (o_orderkey * 7) % 5 AS int) AS Certainty,
  CASE (o_orderkey DIV 2) % 5 WHEN 0 THEN 'Epilepsy' WHEN 3 THEN 'Epilepsy' WHEN 1 THEN 'SingleSeizure'
       WHEN 2 THEN 'MultipleSeizures' END AS DiagCategory,
  CASE (o_orderkey DIV 5) % 8 WHEN 0 THEN 'C0014544' WHEN 1 THEN 'C1096063' WHEN 2 THEN 'C1406659'
       WHEN 3 THEN 'C0014557' WHEN 4 THEN 'C0393720' WHEN 5 THEN 'C9000001' WHEN 6 THEN 'C9000002'
       ELSE 'C9000003' END AS CUI,
  {NHS} AS NHS_No
FROM {{orders}}""",
    # The trusted list, one row per customer.
    "trusted_v": f"""
SELECT c_custkey AS SYSTEM_ID, cast(4000000000 + c_custkey AS string) AS NHS_NUMBER,
  CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 9 END AS GENDER_CD,
  CASE WHEN c_custkey % 12 IN (3, 5, 8, 10) AND c_custkey % 31 = 30 THEN NULL
       WHEN c_custkey % 12 = 1 AND c_custkey % 31 >= 28 THEN NULL
       ELSE cast(concat(cast({CLEAN_DOB_YEAR} AS string), '-',
                        lpad(cast(1 + c_custkey % 12 AS string), 2, '0'), '-',
                        lpad(cast(1 + c_custkey % 31 AS string), 2, '0')) AS date) END AS DATE_OF_BIRTH,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE concat('PC', cast(c_nationkey AS string)) END AS PostCode
FROM {{customer}}""",
}


def sql(view, engine):
    text = VIEWS[view]
    if engine == "spark":
        return text.replace(" DIV ", " div ").replace('"', "`")
    text = text.replace(" DIV ", " // ").replace("date_add(cast(o_orderdate AS date), ",
                                                 "(cast(o_orderdate AS date) + ")
    return text.format(**{t: t for t in TABLES})


def load(spark, sf_dir, view):
    """One view as a DataFrame over the tables in `sf_dir`."""
    text = sql(view, "spark")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text}
    return spark.sql(text, **used)


def ctes(*views):
    """`WITH` clause that defines the views for DuckDB."""
    return "WITH " + ",\n".join(f"{v} AS ({sql(v, 'duckdb')})" for v in views)
