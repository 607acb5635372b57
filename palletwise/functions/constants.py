"""Fixed values that must equal the behaviour being matched.

Everything here is a plain constant, kept together so it can be audited.
"""

# ---------------------------------------------------------------------------
# Text tokens a tabular reader treats as missing (the default
# missing-value list of the pandas CSV / workbook readers).
# ---------------------------------------------------------------------------
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Fixed value: what counts as a number in lenient numeric coercion.
# Accepts 1e3, " 12 ", .5, 5., -5.5; rejects 1d, inf, $5, 0x10, 1_000, "".
NUM_RE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

# Fixed value: integer text (exact path of item-id formatting).
INT_RE = r"^\s*[+-]?\d+\s*$"

# Fixed value: a number written with single underscores between digits, as
# Python's float() accepts it (``1_000``, ``1_0.5e1_0``).
UNDERSCORE_NUM_RE = r"^\s*[+-]?(\d(_?\d)*)?(\.(\d(_?\d)*)?)?([eE][+-]?\d(_?\d)*)?\s*$"

# Column names of the input contracts.
INVENTORY_REQUIRED = ("series_desc", "pallet_id", "item_id", "item_desc", "us_price", "quantity")
REFERENCE_REQUIRED = ("no.", "description")

# Id-column aliases.  ID_ALIASES_PRIORITY is tried in this
# order; ID_ALIASES_FILE_ORDER picks the first file column in the set.
ID_ALIASES_PRIORITY = ("item_id", "no.", "no", "item_number", "number")
ID_ALIASES_FILE_ORDER = ("item_id", "no.", "item_number", "number")

# File admission.
UPLOAD_EXTENSIONS = (".xlsx", ".xls")
JOB_EXTENSIONS = ("csv", "xlsx")
CATALOGUE_TYPES = ("pdf", "csv", "xlsx")

# Sizes and limits.
SNIFF_CHARS = 1024              # delimiter sniff sample
REPORT_LINES_PER_PAGE = 23      # int((792 - 300 - 50) / 18) - 1 on a letter page
REPORT_DESC_WIDTH = 40          # description cut, then "..."
REF_ITEM_LEN = 100              # item_number cut
REF_DESC_LEN = 500              # description cut
REF_SOURCE_LEN = 255            # source_file cut
RETENTION_MINUTES = 5
DEFAULT_PAGE_LIMIT = 10

# Text of the purchase-order report.
TOTAL_LABEL = "TOTAL:"
MISSING_TEXT = "nan"            # how a missing description / id prints
NO_DATE = "N/A"

# Default purchase-order header attributes.
PO_HEADER_FIELDS = (
    "purchase_info",
    "order_date",
    "seller_name",
    "seller_PO",
    "seller_address",
    "company_name",
    "company_address",
    "company_info",
    "shipping_method",
    "payment_terms",
)
PO_HEADER_REPORT_DEFAULTS = {
    "purchase_info": "N/A",
    "order_date": "N/A",
    "shipping_method": "N/A",
    "payment_terms": "N/A",
}
