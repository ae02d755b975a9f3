"""Fixed values the results depend on: vocabularies, limits, month names, texts."""

# Closed vocabularies, in declaration order.
PARSER_FORMATS = [
    "auchan.paper.v1",
    "leclerc.paper.v1",
    "leclerc.paper.v2",
    "leclerc.web.v1",
    "u.paper.v1",
    "u.paper.v2",
]
PARSER_STATUSES = ["parsed", "needs_review", "reviewed"]
LINE_KINDS = ["item", "fee", "discount"]
UNITS_OF_MEASURE = ["piece", "kg", "g", "l", "ml"]
MATCH_STATUSES = ["suggested", "confirmed", "rejected", "ignored"]
TERMINAL_STATUSES = ["confirmed", "ignored"]
MATCH_SOURCES = ["user", "heuristic"]
PAYMENT_CATEGORIES = ["bank_card", "tickets_restaurant", "cash", "web", "other"]
PROMOTION_KINDS = [
    "loyalty_cash_credit",
    "loyalty_cash_debit",
    "immediate_discount",
    "coupon",
    "points_accrual",
    "points_consumption",
]
PROMOTION_UNITS = ["euro_cents", "vignette_count", "point_count"]
LINKING_METHODS = ["parser_inferred", "user_confirmed", "unallocated"]
DETECTION_STATUSES = ["pending", "classified", "needs_classification"]
DETECTION_CONFIDENCES = ["none", "low", "high", "manual"]
CHANNELS = ["physical", "drive", "click_collect"]
EQUIVALENCES = ["equivalent", "comparable_size", "different_size"]
OBSERVATION_SOURCES = ["receipt_line"]

# Admitted upload types by file extension.
MIME_TYPES = {
    "pdf": "application/pdf",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
}

# Store channels allowed per receipt format.
FORMAT_CHANNELS = {
    "auchan.paper.v1": ["physical"],
    "leclerc.paper.v1": ["physical"],
    "leclerc.paper.v2": ["physical"],
    "leclerc.web.v1": ["drive", "click_collect"],
    "u.paper.v1": ["physical"],
    "u.paper.v2": ["physical"],
}

# Limits.
MONETARY_TOLERANCE_CENTS = 1
MINIMUM_SCORE = 0.18
SEARCH_LIMIT_DEFAULT = 20
SEARCH_LIMIT_MAX = 100
SUGGESTION_LIMIT_DEFAULT = 5
SUGGESTION_LIMIT_MAX = 20
PAGE_SIZE = 20
RECENT_ROWS = 5
MINIMUM_HINT_LENGTH = 3

# Validators in report order, and the warning each one raises.
VALIDATORS = ["validate_totals_sum", "validate_article_count", "validate_payments_sum"]
VALIDATOR_WARNINGS = {
    "validate_totals_sum": "totals_sum_mismatch",
    "validate_article_count": "article_count_mismatch",
    "validate_payments_sum": "payments_sum_mismatch",
}

# Warning texts.
TOTALS_TEXT = "Line totals differ from receipt total by %d %s"
ARTICLES_TEXT = "Article count differs from declared count by %d"
PAYMENTS_TEXT = "Payment sum differs from receipt total by %d %s"
DUPLICATE_TEXT = "Possible duplicate of receipt %s"
VAT_TEXT = "No VAT table row found for code %s"
FAILURE_TEXT = "Parser failed: %s"

# French month names and abbreviations.
MONTHS = {
    "janvier": 1, "janv": 1,
    "février": 2, "févr": 2,
    "mars": 3,
    "avril": 4, "avr": 4,
    "mai": 5,
    "juin": 6,
    "juillet": 7, "juil": 7,
    "août": 8,
    "septembre": 9, "sept": 9,
    "octobre": 10, "oct": 10,
    "novembre": 11, "nov": 11,
    "décembre": 12, "déc": 12,
}

# List-valued and object-valued store identifier keys.
ARRAY_IDENTIFIERS = ["receipt_header_patterns", "receipt_store_codes", "legal_entities"]
OBJECT_IDENTIFIERS = ["detection_hints", "private_detection_hints"]

# Catalogue label texts.
BREADCRUMB_SEPARATOR = " > "
LABEL_SEPARATOR = " — "
PRIVATE_LABEL_TEXT = "%s (%s private label)"
