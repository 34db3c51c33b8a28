"""Codes, names and thresholds that decide results."""

# Generic medicine names in match order: (generic, column, value). A row takes
# the first entry that matches. Union of the two published maps.
GENERIC_NAMES = (
    ("Sodium Valproate", "NAME", "Epilim"),
    ("Sodium Valproate", "NAME", "Epilim Chrono"),
    ("Sodium Valproate", "CUI", "C0591452"),
    ("Sodium Valproate", "CUI", "C0037567"),
    ("Lamotrigine", "NAME", "Lamotrigine"),
    ("Lamotrigine", "NAME", "Lamictal"),
    ("Lamotrigine", "CUI", "C0064636"),
    ("Levetiracetam", "NAME", "Levetiracetam"),
    ("Levetiracetam", "NAME", "Keppra"),
    ("Levetiracetam", "CUI", "C0377265"),
    ("Eslicarbazepine", "CUI", "C2725260"),
    ("Carbamazepine", "NAME", "Tegretol"),
    ("Carbamazepine", "NAME", "Carbamazepine"),
    ("Carbamazepine", "CUI", "C0700087"),
    ("Carbamazepine", "CUI", "C0006949"),
    ("Carbamazepine", "CUI", "C0360123"),
    ("Phenytoin", "NAME", "Phenytoin"),
    ("Topiramate", "NAME", "Topiramate"),
    ("Topiramate", "CUI", "C0076829"),
    ("Topiramate", "NAME", "Topamax"),
    ("Brivaracetam", "NAME", "Brivaracetam"),
    ("Clobazam", "NAME", "Clobazam"),
    ("Zonisamide", "NAME", "Zonisamide"),
    ("Lacosamide", "NAME", "Lacosamide"),
    ("Perampanel", "NAME", "Perampanel"),
    ("Perampanel", "CUI", "C2698764"),
    ("Clonazepam", "CUI", "C0009011"),
    ("Gabapentin", "CUI", "C0060926"),
    ("Lacosamide", "CUI", "C0893761"),
    ("Primidone", "CUI", "C0700016"),
    ("Pregabalin", "CUI", "C0657912"),
    ("Midazolam", "CUI", "C0026056"),
)

# Codes that each published map lacks.
V1_WITHOUT = {("CUI", "C0360123"), ("NAME", "Perampanel")}
V2_WITHOUT = {("CUI", "C0006949")}

# A code whose prescriptions count once a day when no frequency is written.
ONCE_DAILY_CODES = ("C0055891",)

# Days in a stated time period.
PERIOD_DAYS = {"Day": 1, "Week": 7, "Month": 30, "Year": 365}
# Weeks in a month, for counts given per week within a named month.
WEEKS_PER_MONTH = 4.3
# Days before the record date for a point in time given in words.
POINT_IN_TIME_DAYS = {"Last_Month": 30, "Last_Year": 365}

# Severity of seizure freedom: score for fewer than this many days.
FREE_DAYS_BELOW = ((7, 6), (30, 5), (182, 4), (365, 3), (730, 2))
FREE_DAYS_LONGEST = 1
# Severity of a daily rate: score above this rate.
RATE_ABOVE = ((1, 7), (0.2857143, 6), (0.0657534, 5), (0.0109589, 4), (0.0054795, 3),
              (0.0027322, 2))
# Lowest score, strictly below this rate.
RATE_LOWEST = (0.0027321, 1)

# Codes that say "epilepsy" without saying which type.
NON_SPECIFIC_CODES = ("C0014544", "C1096063", "C1406659", "C0014557", "C0393720")
# Codes for dissociative seizures.
DISSOCIATIVE_CODES = ("C3495874", "C1142430", "C0349245")

EPILEPSY_TYPES = ("Focal", "Generalised")


def generic_names(version=None):
    """The medicine map: both versions together, or only version 1 or 2."""
    without = {None: set(), 1: V1_WITHOUT, 2: V2_WITHOUT}[version]
    return tuple(e for e in GENERIC_NAMES if e[1:] not in without)
