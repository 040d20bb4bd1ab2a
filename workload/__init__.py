"""Queries over the driver's tables: how each operator is fed, and the SQL that checks it."""
