"""Queries over the test tables, with equivalent SQL."""
