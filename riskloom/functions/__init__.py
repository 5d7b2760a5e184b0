"""Column functions: names, texts, URLs, times and code sketches."""
