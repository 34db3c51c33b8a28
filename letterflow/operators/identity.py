"""From identity fields on annotations to one identity file and back."""

from functools import reduce

from pyspark.sql import Window, functions as F

from letterflow.functions.lookups import DISSOCIATIVE_CODES
from letterflow.functions.scalars import gender_code, normalise_id
from letterflow.operators.joins import join_null_safe
from letterflow.operators.ranges import AT, PART, SIZE, ranged, sizes
from letterflow.sources.sink import keep, keep_bucketed, new_folder

IDENTITY = ("NHS_No", "Surname", "FirstName", "DoB", "Gender", "PostCode", "Address")
# Who a record is about, when the NHS number is not written.
PERSON_KEYS = ("Surname", "FirstName", "DoB", "GENDER_CD", "PostCode")
FILE_NAMES = {"NHS_No": "NHS_NUMBER", "Surname": "SURNAME", "FirstName": "FORENAME",
              "DoB": "DATE_OF_BIRTH", "PostCode": "POSTCODE"}

# The five person keys as one column.
KEY = "_person"


def _tables(dfs):
    return list(dfs.values()) if isinstance(dfs, dict) else list(dfs)


def people_count(dfs, id_col="NHS_No"):
    """Number of distinct known people over several tables."""
    ids = [df.select(normalise_id(id_col).alias(id_col)) for df in _tables(dfs)]
    return reduce(lambda a, b: a.unionByName(b), ids).agg(
        F.count_distinct(id_col).alias("people"))


def with_upper_surname(df):
    return df.withColumn("Surname", F.upper("Surname"))


def individuals(dfs):
    """Distinct identity fields over all annotation tables."""
    rows = [with_upper_surname(df).select(*IDENTITY) for df in _tables(dfs)]
    return reduce(lambda a, b: a.unionByName(b), rows).distinct()


def individuals_known(ind):
    """Distinct identities that have an NHS number, regardless of address."""
    return (ind.drop("Address").filter(F.col("NHS_No").isNotNull()).distinct()
            .withColumnRenamed("NHS_No", "NHS1"))


def with_row_ids(df, path=None, out="SYSTEM_ID"):
    """Number rows 1..n in the order of their columns, NULL last, the same way on every run.

    The rows are kept in `path`, a new folder, in ranges of that order; a row's number is its
    place in its range after the rows of the ranges before, of which one task sums one number
    each. No key meets in one task. Equal rows get numbers next to each other.
    """
    columns = df.columns
    rows = ranged(df, columns, path or new_folder(df.sparkSession, "row-ids"))
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes(rows).select(F.col(PART).alias("_of"), F.coalesce(F.sum(SIZE).over(before), F.lit(0)).alias("_offset"))
    return rows.join(F.broadcast(offsets), F.col(PART) == F.col("_of")).withColumn(
        out, F.col("_offset") + F.col(AT) + 1).select(*columns, out)


def person_key(keys=PERSON_KEYS):
    """The person keys as one text: equal if and only if all keys are, NULL with NULL."""
    def part(k):
        text = F.col(k).cast("string")
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return F.concat(*[part(k) for k in keys])


def identity_file(ind, as_of, path=None):
    """One row per person, post code and NHS number, with a dense SYSTEM_ID.

    An identity without any known NHS number stays with NULL. The address is the
    first one, in text order, of the identity. `as_of` is the load date. Ids follow the
    order of the file's columns.

    Two aggregates, each combined before it is shuffled: first the numbers of every person,
    with the first address beside each, then the first address of all and how many numbers
    are known. So a placeholder person with any number of addresses is one row a task. The
    numbers are kept in the new folder `path`, which evaluates `ind` once, and the file after them.
    """
    path = path or new_folder(ind.sparkSession, "identity")
    known = ind.filter(F.col("DoB").isNotNull() & F.col("Surname").isNotNull())
    rows = known.withColumn("GENDER_CD", gender_code("Gender"))
    numbers = keep(rows.groupBy("NHS_No", *PERSON_KEYS).agg(F.min("Address").alias("_address")), f"{path}/numbers")
    people = numbers.groupBy(*PERSON_KEYS).agg(
        F.translate(F.min("_address"), ",", "").alias("ADDRESS_1"), F.count("NHS_No").alias("_known"))
    numbered = join_null_safe(
        numbers.filter(F.col("NHS_No").isNotNull()).drop("_address"), people.drop("_known"), list(PERSON_KEYS), "inner")
    unnumbered = people.filter(F.col("_known") == 0).withColumn("NHS_No", F.lit(None).cast(dict(ind.dtypes)["NHS_No"]))
    columns = ["NHS_No", *PERSON_KEYS, "ADDRESS_1"]
    file = numbered.select(*columns).unionByName(unnumbered.select(*columns)).withColumnsRenamed(FILE_NAMES)
    return with_row_ids(file, f"{path}/file").withColumn("CREATE_DATE", F.lit(as_of).cast("date"))


def bucketed_identity(identity, path, buckets=None):
    """The identity file in buckets of the five person keys, which `match_identity` joins without shuffling it."""
    keys = [FILE_NAMES.get(k, k) for k in PERSON_KEYS]
    buckets = buckets or int(identity.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keep_bucketed(identity.withColumn(KEY, person_key(keys)), path, KEY, buckets)


def match_identity(df, identity, hot_rows=None, hot=None, right_hot=None):
    """Annotations with SYSTEM_ID, NHS number and address of their identity.

    All five keys must agree, NULL with NULL. An annotation is repeated if its
    identity has several NHS numbers. An identity file of `bucketed_identity` stays where it
    is, whatever number of tables is matched to it, unless common identities are named.
    """
    rows = with_upper_surname(df).withColumn("GENDER_CD", gender_code("Gender"))
    keys = {k: FILE_NAMES.get(k, k) for k in PERSON_KEYS}
    if KEY in identity.columns:
        if hot_rows is None and hot is None and right_hot is None:
            others = [c for c in identity.columns if c not in keys.values()]
            return rows.withColumn(KEY, person_key()).join(identity.select(*others), KEY, "left").drop(KEY)
        identity = identity.drop(KEY)
    return join_null_safe(rows, identity, keys, "left", hot_rows, hot=hot,
                          right_hot_rows=hot_rows, right_hot=right_hot)


def code_cohort(df, codes=DISSOCIATIVE_CODES, min_certainty=4):
    """Distinct people with one of the codes, stated firmly enough."""
    return (df.filter(F.col("CUI").isin(*codes) & (F.col("Certainty") >= min_certainty))
            .select("SYSTEM_ID").distinct())
