"""Registered queries over the supplied tables, with SQL that gives the same result."""
