"""Registered queries over the given tables, each with the independent SQL that checks it."""
