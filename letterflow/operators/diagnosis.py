"""Diagnosis annotations: class per annotation, per letter and per person."""

from pyspark.sql import functions as F

from letterflow.functions.lookups import EPILEPSY_TYPES, NON_SPECIFIC_CODES
from letterflow.functions.scalars import normalise_id
from letterflow.operators.joins import lookup_join

FIRM = (4, 5)


def diagnosis_class(df, out="Diag"):
    """Epilepsy if stated firmly and not a single seizure; NO for a single seizure."""
    category = F.col("DiagCategory")
    return df.withColumn(
        out, F.when(F.col("Certainty").isin(*FIRM) & (category != "SingleSeizure"), "Epilepsy")
        .when(category == "SingleSeizure", "NO"))


def annotation_diagnosis(df):
    """Distinct class per annotation."""
    return df.select("Letter", "Start", "Diag", "NHS_No").distinct()


def letter_diagnosis(df):
    """Distinct classes per letter."""
    return df.select("Letter", "Diag").distinct()


def letter_epilepsy(df):
    """One row per letter: Epilepsy if any annotation says so, else NULL."""
    positive = F.when(F.col("Diag") == "Epilepsy", F.col("Diag"))
    return df.groupBy("Letter").agg(F.max(positive).alias("Epilepsy"))


def people(df, id_col="NHS_No"):
    """Distinct known identifiers, blanks and hyphens removed."""
    return df.select(normalise_id(id_col).alias(id_col)).na.drop().distinct()


def people_with_epilepsy(df):
    """People with a firm diagnosis of epilepsy, of whatever type."""
    return people(df.filter((F.col("Diag") == "Epilepsy")
                            & (F.col("DiagCategory") == "Epilepsy")))


def specific_type(df, excluded=NON_SPECIFIC_CODES):
    """Epilepsy annotations whose code names a type or syndrome."""
    rows = df.filter((F.col("DiagCategory") == "Epilepsy") & ~F.col("CUI").isin(*excluded))
    return rows.withColumn("NHS_No", normalise_id("NHS_No"))


def type_counts(df, type_list, types=EPILEPSY_TYPES):
    """Known people per epilepsy type, from the rows of `specific_type`."""
    codes = type_list.select("CUI", "EpilepsyType").distinct()
    rows = df.select(F.translate("CUI", " ", "").alias("CUI"),
                     normalise_id("NHS_No").alias("NHS_No"))
    typed = lookup_join(rows, codes, "CUI")
    return (typed.filter(F.col("EpilepsyType").isin(*types))
            .groupBy("EpilepsyType").agg(F.count_distinct("NHS_No").alias("people")))
