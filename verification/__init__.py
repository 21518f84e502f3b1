"""Queries over the supplied tables and the SQL that checks them."""
