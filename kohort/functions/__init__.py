"""Column-level helpers: NULL rules, recodes, dates, row-wise reductions, math."""
