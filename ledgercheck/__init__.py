"""ledgercheck: data-quality checks for finance master data and postings on Spark."""

__version__ = "0.1.0"
PACK_VERSION = "0.1"
