"""Writers: JSON rows and documents, SARIF, Markdown, text tables."""
