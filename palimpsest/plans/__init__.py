"""From a query text to a DataFrame: the MATCH grammar, phrase matching, ranking and search."""
