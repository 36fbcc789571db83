"""Column functions: values, dates, text."""
