"""Reading documents from files and writing one file per document."""
