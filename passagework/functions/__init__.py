"""Column expressions: text, files, vectors, snippets, front matter."""
