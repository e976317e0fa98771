"""PySpark library for auditing validation claims over rows that are not independent."""
