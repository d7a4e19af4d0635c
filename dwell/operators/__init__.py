"""Relational operators over DataFrames: joins, statistics, windows, ordering, sets, splits, rules."""
