"""Registered queries over the driver's tables, each with the SQL that states the same rows."""
