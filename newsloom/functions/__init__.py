"""Column -> Column functions: text, urls, dates, reader cards."""
