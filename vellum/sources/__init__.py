"""Where repositories and their files come from."""
