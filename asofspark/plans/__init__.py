"""Registered queries over the driver's tables, with the SQL they are checked against."""
