"""Queries over the given tables that exercise every operator, with SQL that must agree."""
