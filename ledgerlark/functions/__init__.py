"""Column functions: blanks, text, URLs, rules, tokens, pages."""
