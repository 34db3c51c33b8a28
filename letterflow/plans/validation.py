"""The validation questions in SQL, over any extracted table and the trusted list; the date tables put together."""

from letterflow.operators.skew import HOT_ROWS, frequent_keys
from letterflow.operators.validation import clinic_letter_full, dates_with_letters

# {extracted}, {trusted}: tables; {id}, {value}, {trusted_value}: column names.
COUNT_PER_ID = "SELECT {id}, count({id}) AS n FROM {{extracted}} GROUP BY {id}"
MATCH_PER_ID = """
SELECT a.{id}, min(a.{value}) AS {value}, max(b.v IS NOT NULL) AS matched
FROM {{extracted}} a
LEFT JOIN (SELECT DISTINCT {trusted_value} AS v FROM {{trusted}}) b ON a.{value} = b.v
GROUP BY a.{id}"""
MISSED = """
SELECT {id} FROM {{trusted}} t
WHERE {id} IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM {{extracted}} e WHERE e.{id} = t.{id})"""

QUESTIONS = {"count": COUNT_PER_ID, "match": MATCH_PER_ID, "missed": MISSED}


def ask(spark, question, extracted, trusted, value, trusted_value=None, id="SYSTEM_ID"):
    """Run one of `QUESTIONS` through Spark SQL."""
    text = QUESTIONS[question].format(id=id, value=value, trusted_value=trusted_value or value)
    tables = {"extracted": extracted, "trusted": trusted}
    return spark.sql(text, **{k: v for k, v in tables.items() if f"{{{k}}}" in text})


def date_tables(clinic, letter, letters, on="LETTER", hot_rows=HOT_ROWS, suffix=None):
    """Clinic dates, letter dates and the letter list in two full joins, with every row of each.

    Letters of more than `hot_rows` rows in a table are found by one sketch over the three narrow
    key columns and spread in both joins, so no list of them is needed.
    """
    in_clinic, in_letter, in_list = frequent_keys([clinic, letter, letters], on, hot_rows)
    both = clinic_letter_full(clinic, letter, on, hot=in_clinic, right_hot=in_letter)
    # a letter is as common in both as in either, so both lists are told to the second join
    either = in_clinic.unionByName(in_letter).groupBy(f"_h_{on}").agg({"_h_parts": "max"}).withColumnRenamed(
        "max(_h_parts)", "_h_parts")
    return dates_with_letters(both, letters, on, suffix=suffix, hot=either, right_hot=in_list)
