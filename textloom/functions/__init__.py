"""Column functions: text, dates, terms, jurisdictions, titles, parties, comparison."""
