"""Column functions: text, frontmatter, identifiers, vectors, labels."""
