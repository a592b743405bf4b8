"""Column functions: fixed values, text, urls, dates and keywords."""
