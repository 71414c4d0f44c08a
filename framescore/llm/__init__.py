"""Training-data operators: large-scale text, page and vector operators and their queries."""
