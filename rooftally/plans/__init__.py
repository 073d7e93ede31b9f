"""Queries over the tables: importing a module here registers its queries."""
