from .tables import TABLES, ntz_to_utc, table, utc_to_ntz  # noqa: F401
