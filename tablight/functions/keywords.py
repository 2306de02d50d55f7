"""Name-keyword tables used by the column-role rules.

FIXED VALUES: these word lists must equal the ones the analytics rules were
defined with, so that column roles, aggregations and priorities agree.  They
are listed as plain text, in their natural order.
"""

# --- FIXED VALUES: identifier detection ------------------------------------
ID_AFFIXES = ["id", "uuid", "pk", "fk", "key", "code", "ref", "hash"]
ENTITY_NAME_TOKENS = ["player", "oyuncu"]
LABEL_NAME_TOKENS = ["name", "title", "label", "description", "isim", "ad"]

# --- FIXED VALUES: label-column choice (earlier = stronger) ----------------
LABEL_KEYWORDS = [
    "playername", "player", "oyuncu", "customername", "customer", "musteri",
    "productname", "product", "urun", "team", "club", "employee", "name",
    "isim", "label", "title", "category", "region", "department",
]

# --- FIXED VALUES: KPI rules ------------------------------------------------
MEANINGLESS_TOTAL = [
    "delta", "diff", "duration", "elapsed", "lag", "offset",
    "tenure", "age_days", "day_count", "days_since", "days_to",
    "lead_time", "cycle_time",
]
NEGATIVE_PREFIXES = [
    "error", "fault", "fail", "penalty", "violation", "foul", "incident", "warning",
]
DOMAIN_PRIORITY = [
    "revenue", "profit", "sales", "income", "margin", "earning",
    "goal", "assist", "score", "match", "game", "gol", "asist", "mac",
    "salary", "cost", "price", "amount", "total", "volume",
    "rating", "satisfaction", "conversion", "churn", "retention",
]
MEAN_AGGREGATED = [
    "percent", "percentage", "ratio", "rate", "pct", "%",
    "accuracy", "completion",
    "rating", "score", "xg", "avg", "average", "mean",
    "index", "satisfaction",
]
PERCENT_DISPLAY = ["percent", "percentage", "pct", "%"]

# --- FIXED VALUES: histogram skip list --------------------------------------
HISTOGRAM_SKIP = [
    "count", "quantity", "qty", "_id", "index", "rank", "order",
    "year", "month", "day", "hour", "minute", "second",
    "delta", "diff", "duration", "elapsed", "lag", "offset", "tenure",
    "zipcode", "zip", "postal", "phone", "latitude", "longitude", "lat", "lon",
]

# --- FIXED VALUES: statistical insight ranking ------------------------------
INSIGHT_PRIORITY = ["profit", "sales", "revenue", "price", "unit", "cost", "target", "operating"]

# --- FIXED VALUES: metric semantics ------------------------------------------
METRIC_SAFE_TOKENS = [
    "grade", "rating", "score", "attendance", "hour", "duration", "time",
    "revenue", "sales", "profit", "cost", "amount", "quantity", "volume",
]
LOWER_IS_BETTER = [
    "cost", "debt", "risk", "error", "defect", "mortality", "readmission",
    "complication", "churn", "dropout", "default", "fraud", "downtime",
    "waste", "delay", "reactiontime", "recency",
]
HIGHER_IS_BETTER = ["grade", "rating", "score", "attendance", "revenue", "sales", "profit"]
TOTAL_OR_COUNT = ["total", "count", "numberof", "num"]

# --- FIXED VALUES: domain keywords (role classification) --------------------
DOMAIN_KEYWORDS = {
    "football_soccer": ["player", "team", "club", "position", "goal", "gol", "assist", "asist",
                        "rating", "xg", "shot", "minute", "match"],
    "sales": ["sales", "revenue", "profit", "margin", "quantity", "order", "product", "region",
              "customer"],
    "hr": ["employee", "department", "salary", "attrition", "performance", "overtime", "tenure"],
    "logistics": ["delivery", "delay", "leadtime", "route", "vendor", "shipment", "stock",
                  "inventory", "cost"],
    "finance": ["amount", "price", "cost", "balance", "transaction", "revenue", "profit"],
}
# --- FIXED VALUES: column roles; the first rule that fits counts -------------
# (domain, words of the normalised name, needs a number, role, importance, aggregation)
ROLE_RULES = [
    ("any", ["id", "uuid", "code", "key"], False, "identifier", 1, "none"),
    ("any", ["date", "time", "tarih", "orderdate"], False, "time", 4, "none"),
    ("football_soccer", ["player", "oyuncu"], False, "primary_entity", 5, "none"),
    ("football_soccer", ["team", "club", "position"], False, "dimension", 4, "none"),
    ("football_soccer", ["rating"], True, "primary_metric", 5, "mean"),
    ("football_soccer", ["goal", "gol", "assist", "asist", "xg"], True, "primary_metric", 5, "sum"),
    ("football_soccer", ["shot", "minute"], True, "secondary_metric", 4, "sum"),
    ("sales", ["product", "region", "customer"], False, "dimension", 4, "none"),
    ("sales", ["sales", "revenue", "profit", "quantity"], True, "primary_metric", 5, "sum"),
    ("sales", ["margin"], True, "secondary_metric", 4, "mean"),
    ("hr", ["employee", "department", "role"], False, "dimension", 4, "none"),
    ("hr", ["salary", "performance", "overtime", "tenure"], True, "primary_metric", 4, "mean"),
    ("logistics", ["route", "vendor", "shipment"], False, "dimension", 4, "none"),
    ("logistics", ["delivery", "delay", "leadtime", "stock", "quantity", "cost"], True, "primary_metric", 4, "sum"),
    ("any", [""], True, "secondary_metric", 3, "mean"),
    ("any", [""], False, "dimension", 3, "none"),
]

# --- FIXED VALUES: semantic types of metrics; the first rule that fits counts -
# (words of the name, type, what else must hold)
SEMANTIC_TYPE_RULES = [
    (["grade", "rating", "score"], "score", None),
    (["percentage", "percent", "pct"], "percentage", None),
    (["rate", "ratio"], "rate", None),
    (["attendance"], "percentage", "share_of_100"),
    (["hour", "duration", "minutes", "time", "reactiontime"], "duration", None),
    (["revenue", "sales", "profit", "amount", "cost", "price", "salary"], "money", None),
    (["count"], "count", None),
    (["quantity", "volume", "qty"], "quantity", None),
    (["index"], "index", None),
]
# (words of the name, semantic types, what else must hold): values that must not be added up
AVERAGED_RULES = [
    ([], ["score", "percentage", "rate", "duration", "index"], None),
    (["grade", "rating", "score", "reactiontime", "gaminghour", "studyhour", "sleephour"], [], None),
    (["attendance"], [], "no_total"),
]
ADDED_NAMES = ["revenue", "sales", "profit", "amount", "quantity", "volume", "count", "cost"]

# Column-card hint keywords (slightly different spelling set).
HINT_KEYWORDS = {
    "football_soccer": ["player", "team", "club", "position", "goals", "goal", "gol",
                        "assists", "assist", "asist", "rating", "xg", "shots", "minutes",
                        "minute", "match"],
    "sales": ["sales", "revenue", "profit", "margin", "quantity", "order",
              "product", "region", "customer"],
    "hr": ["employee", "department", "salary", "attrition", "performance",
           "overtime", "tenure"],
    "logistics": ["delivery", "delay", "lead_time", "lead time", "route", "vendor",
                  "shipment", "stock", "inventory", "cost"],
    "finance": ["amount", "price", "cost", "balance", "transaction", "revenue",
                "profit"],
}

# --- FIXED VALUES: join matching ---------------------------------------------
DATE_NAME_TOKENS = ["date", "dt", "time", "timestamp", "gün", "tarih", "yil", "yıl", "ay"]
KEY_NAME_TOKENS = ["id", "key", "no", "code", "pk"]

# --- FIXED VALUES: boolean-looking values ------------------------------------
BOOLEAN_TEXT = ["True", "False", "Yes", "No"]

# --- FIXED VALUES: text cleaning (printable ASCII plus these letters) --------
EXTRA_LETTERS = "üÜğĞıİşŞçÇöÖ"

# Date formats tried when text is parsed as a date (besides ISO cast).
DATE_FORMATS = ["yyyy-M-d", "yyyy/M/d", "M/d/yyyy", "d.M.yyyy", "yyyy-M-d H:m:s"]
