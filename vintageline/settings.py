"""Fixed values of the risk design: horizons, split dates, features, scaling."""

from datetime import date

# Survival framing.
HORIZON_MONTHS = 12
DELINQUENCY_THRESHOLD = 3

# Temporal and vintage splits.
TRAIN_END = date(2015, 12, 1)
VALIDATION_END = date(2017, 12, 1)
HELD_OUT_QUARTERS = ("2016Q1", "2018Q1")

# Macro series joined point in time.
MACRO_SERIES = ("UNRATE", "CSUSHPINSA", "MORTGAGE30US")
HPI_SERIES = "CSUSHPINSA"

# Columns that look past the row's own month; never usable as features.
OUTCOME_COLUMNS = (
    "AT_RISK_OBSERVED_MONTHS",
    "DEFAULT_IN_12M",
    "DEFAULT_NEXT_MONTH",
    "EXIT_DATE",
    "EXIT_TYPE",
    "FIRST_CENSOR_CODE",
    "FIRST_CENSOR_DATE",
    "FIRST_D90_DATE",
    "HORIZON_END_DATE",
    "LABEL_OBSERVED_12M",
    "LAST_OBSERVED_DATE",
    "SOURCE_OBSERVED_MONTHS",
)

# Model contract.
FEATURES = (
    "CLASSIC_FICO",
    "OLTV",
    "DTI",
    "CURRENT_LTV",
    "SEASONING_MONTHS",
    "UNRATE",
    "MORTGAGE30US",
)
TARGET_12M = "DEFAULT_IN_12M"
TARGET_NEXT = "DEFAULT_NEXT_MONTH"
SEED = 20260921
BOOTSTRAP_REPLICATES = 500
BOOTSTRAP_ALPHA = 0.05
SAMPLE_BUCKETS = 10_000
SAMPLE_KEEP = 20

# Scorecard scaling and binning.
PDO = 20
BASE_ODDS = 50
BASE_POINTS = 600
MAX_PREBINS = 12
MIN_BIN_SHARE = 0.03

# Risk direction of the constrained drivers and the range each is swept over.
RISK_DIRECTION = {"CLASSIC_FICO": -1, "OLTV": 1, "DTI": 1, "CURRENT_LTV": 1}
SWEEP_BOUNDS = {
    "CLASSIC_FICO": (500.0, 850.0),
    "OLTV": (20.0, 150.0),
    "DTI": (0.0, 65.0),
    "CURRENT_LTV": (0.0, 200.0),
}

# Crisis periods reported separately.
STRESS_WINDOWS = {
    "gfc": (date(2008, 1, 1), date(2010, 12, 1)),
    "covid": (date(2020, 3, 1), date(2020, 12, 1)),
}
