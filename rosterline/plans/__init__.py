"""Registered queries, each with the SQL that another engine runs to check it."""
