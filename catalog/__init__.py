"""Registered queries over the order tables, each with its SQL twin."""
