"""Registered queries: an operator applied to a table, with the SQL that gives the same rows."""
