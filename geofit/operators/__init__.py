"""Operators: DataFrame(s) in, DataFrame out. No operator collects data-sized frames."""
