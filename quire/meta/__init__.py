"""Frontmatter: finding it, reading four formats into one tree, editing and writing it back."""
