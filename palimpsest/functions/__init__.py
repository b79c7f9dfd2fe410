"""Column functions: text identity, tokenizing, snippets, risk scoring and small scalars."""
