"""Reading delimited files: every field as text, then blanks, null tokens and types."""

import re

from pyspark.sql import functions as F, types as T

from letterflow.sources.schemas import (
    ANNOTATION_SCHEMAS, NULL_TOKENS, OLD_SEPARATOR, SPARE)
from letterflow.functions.scalars import to_number


def null_tokens(df, tokens=NULL_TOKENS, cols=None):
    """Trim text columns and turn every null token into NULL."""
    names = cols or [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    clean = {}
    for name in names:
        text = F.trim(F.col(name))
        clean[name] = F.when(~text.isin(*tokens), text)
    return df.withColumns(clean)


def _typed(name, dtype):
    if isinstance(dtype, T.StringType):
        return F.col(name)
    number = to_number(F.col(name))
    # An integer field written "3.0" is still 3; out-of-range text becomes NULL.
    return (number if isinstance(dtype, T.DoubleType) else number.try_cast(dtype)).alias(name)


def _read_text(spark, path, schema, sep, header, line=None):
    """Every field as text; a column `line` holds lines that don't have a field for each column."""
    names = [f.name for f in schema] + ([line] if line else [])
    text = T.StructType([T.StructField(name, T.StringType(), True) for name in names])
    reader = (spark.read.schema(text)
              .option("sep", sep).option("header", header).option("enforceSchema", True)
              .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True))
    if line:
        # without pruning the fields of a line are counted whatever columns are read
        reader = (reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", line)
                  .option("columnPruning", False))
    return reader.csv(path)


def scan_table(spark, path, schema, sep=",", header=True, tokens=NULL_TOKENS):
    """A delimited file with a header, read into `schema`."""
    df = null_tokens(_read_text(spark, path, schema, sep, header), tokens)
    return df.select(*[_typed(f.name, f.dataType) for f in schema])


LINE = "_line"


def scan_checked(spark, path, schema, sep=",", header=True, tokens=NULL_TOKENS):
    """(rows, rejected): lines with a field for each column, read as by `scan_table`, and all others.

    rejected: file, line, fields (how many the separators make), reason. `short` lines have too few
    fields, `long` ones too many; `broken` are those whose quotes hide or open some. Every line
    that is not blank is in one of the two tables.
    """
    raw = _read_text(spark, path, schema, sep, header, LINE).withColumn("_file", F.input_file_name())
    # always true; Spark refuses to look at the rejected lines without any other column
    any_line = F.length(F.coalesce(F.col(schema[0].name), F.lit(""))) >= 0
    good = null_tokens(raw.filter(F.col(LINE).isNull() & any_line).drop(LINE, "_file"), tokens)
    fields = F.size(F.split(F.col(LINE), re.escape(sep)))
    reason = (F.when(F.col(LINE).contains('"'), "broken").when(fields < len(schema), "short")
              .when(fields > len(schema), "long").otherwise("broken"))
    rejected = raw.filter(F.col(LINE).isNotNull() & any_line).select(
        F.col("_file").alias("file"), F.col(LINE).alias("line"), fields.alias("fields"), reason.alias("reason"))
    return good.select(*[_typed(f.name, f.dataType) for f in schema]), rejected


def scan_annotations_checked(spark, path, kind, generation="new", sep=None, tokens=NULL_TOKENS):
    """`scan_annotations` and the rejected lines, as `scan_checked` gives them."""
    sep = sep or _separator(kind, generation)
    rows, rejected = scan_checked(spark, path, ANNOTATION_SCHEMAS[kind, generation], sep, False, tokens)
    return rows.drop(SPARE), rejected


def _separator(kind, generation):
    return OLD_SEPARATOR.get(kind, ",") if generation == "old" else ","


def scan_annotations(spark, path, kind, generation="new", sep=None, tokens=NULL_TOKENS):
    """A headerless annotation file; columns are assigned by position."""
    sep = sep or _separator(kind, generation)
    schema = ANNOTATION_SCHEMAS[kind, generation]
    return scan_table(spark, path, schema, sep, header=False, tokens=tokens).drop(SPARE)


def upper_names(df):
    """The same table with every column name in upper case."""
    return df.toDF(*[c.upper() for c in df.columns])


def register_views(**tables):
    """Make tables visible to `spark.sql` under the given names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
