"""Registered queries over the bundled tables, with their SQL counterparts."""
