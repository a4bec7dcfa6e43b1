"""The registered queries: inputs made from the given tables, one query per
operator, and the equivalent SQL."""
