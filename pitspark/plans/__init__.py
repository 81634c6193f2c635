"""Queries over the test tables, by family; each module has QUERIES and SQL."""

CORE_MODULES = ["times", "records", "series", "quality", "market", "fundamentals", "research", "basics"]
