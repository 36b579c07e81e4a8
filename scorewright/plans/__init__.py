"""Queries over the standard tables and the SQL that they are held against."""
