"""Thin queries on the driver's tables, one module a family."""
