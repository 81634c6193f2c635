"""Operators for text corpora and record matching; nothing else in the package imports this one."""
