"""Fixed values the feature definitions depend on."""

# E-mail providers counted as free.
FREE_EMAIL_DOMAINS = (
    "gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com", "mail.com", "icloud.com", "ymail.com",
    "live.com", "msn.com", "protonmail.com", "gmx.com", "yahoo.com.mx", "att.net", "comcast.net", "cox.net",
    "sbcglobal.net", "verizon.net",
)

# Browser and device patterns on lower-cased text; a later match wins over an earlier one.
BROWSER_PATTERNS = (
    ("chrome", "chrome|crios"),
    ("safari", "safari"),
    ("firefox", "firefox"),
    ("edge_ie", "edge|ie|rv:11"),
    ("samsung", "samsung"),
)
SAFARI_EXCLUDES = "chrome|crios|edge"
MOBILE_PATTERN = "mobile|android|ios"
DEVICE_PATTERNS = (
    ("windows", "windows"),
    ("apple", "ios|mac"),
    ("samsung", "sm-|samsung"),
    ("huawei", "huawei|ale-|rv:"),
    ("motorola", "moto"),
    ("lg", "lg-"),
)

# Fills, weights, spans and limits.
MISSING = "MISSING"
NUMERIC_FILL = -999.0
HISTORY_FILL = -1.0
COMBO_NULL = "-999"
COHORT_MIN_COUNT = 3
TARGET_PRIOR_WEIGHT = 10.0
TRAILING_SPANS_S = {"10min": 600, "1h": 3_600, "24h": 86_400}
MAX_BACKDATE_S = 86_400
MAX_AMOUNT = 1_000_000
MAX_ID_LENGTH = 64
DRIFT_SHARE_THRESHOLD = 0.30
MISSING_SHARE_THRESHOLD = 0.20
DRIFT_WINDOW_ROWS = 5_000
MIN_LIFT = 0.005

# Cost of a missed fraud, of a false alarm, and value of a caught one.
COST_FN = 500.0
COST_FP = 5.0
REVENUE_TP = 480.0
