"""Column functions: text, URLs, robots rules, HTML."""
