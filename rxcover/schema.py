"""Input schemas and the fixed values of the adherence rules."""

from decimal import Decimal

from pyspark.sql import types as T

DRUG_EXPOSURE = T.StructType(
    [
        T.StructField("drug_exposure_id", T.LongType(), False),
        T.StructField("person_id", T.LongType(), False),
        T.StructField("drug_concept_id", T.LongType(), False),
        T.StructField("drug_exposure_start_date", T.DateType()),
        T.StructField("drug_exposure_end_date", T.DateType()),
        T.StructField("days_supply", T.IntegerType()),
        T.StructField("refills", T.IntegerType()),
        T.StructField("quantity", T.DoubleType()),
        T.StructField("drug_type_concept_id", T.LongType()),
    ]
)

CONCEPT = T.StructType(
    [
        T.StructField("concept_id", T.LongType(), False),
        T.StructField("concept_name", T.StringType()),
        T.StructField("concept_class_id", T.StringType()),
        T.StructField("domain_id", T.StringType()),
    ]
)

PERSON = T.StructType(
    [
        T.StructField("person_id", T.LongType(), False),
        T.StructField("year_of_birth", T.IntegerType()),
    ]
)

CONDITION_OCCURRENCE = T.StructType(
    [
        T.StructField("person_id", T.LongType(), False),
        T.StructField("condition_concept_id", T.LongType()),
        T.StructField("condition_start_date", T.DateType()),
    ]
)

# Grain of coverage and adherence: one patient on one drug.
PATIENT_DRUG = ["person_id", "drug_concept_id"]

# Fixed values (must equal the established rules for results to agree):
# dispensed in pharmacy, dispensed by mail order, written prescription
DISPENSED_TYPES = (38000175, 38000176, 581373)
DAYS_PER_REFILL = 30
DEFAULT_SUPPLY_DAYS = 30
DAYS_PER_MONTH = 30
PDC_THRESHOLD = Decimal("0.80")
MODERATE_BAND = Decimal("0.1")
MIN_TREATMENT_DAYS = 30
MIN_GAP_DAYS = 7
MIN_PATIENTS_REPORT = 10
MIN_PATIENTS_LOW_ADHERENCE = 50
HIGH_RISK_GAP_DAYS = 90
HISTOGRAM_BINS = 50

ADHERENT = "Adherent"
MODERATE = "Moderately Adherent"
NON_ADHERENT = "Non-Adherent"

# gap of at least so many days -> label
GAP_SEVERITIES = (
    (90, "Critical Gap (90+ days)"),
    (30, "Major Gap (30-89 days)"),
    (14, "Moderate Gap (14-29 days)"),
    (7, "Minor Gap (7-13 days)"),
)
MINIMAL_GAP = "Minimal Gap (<7 days)"

# PDC bin labels with their lower bounds
PDC_BINS = (
    ("90-100%", Decimal("0.9")),
    ("80-89%", Decimal("0.8")),
    ("70-79%", Decimal("0.7")),
    ("60-69%", Decimal("0.6")),
    ("50-59%", Decimal("0.5")),
)
LOWEST_PDC_BIN = "<50%"
