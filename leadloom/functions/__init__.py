"""Column functions: URLs, text, entities, structured data, labels."""
