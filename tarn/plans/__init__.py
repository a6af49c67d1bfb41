"""Queries of the library on the driver's tables, each with the SQL that a second engine checks it by."""
