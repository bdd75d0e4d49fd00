"""Document trees to text; each renderer is a plain function of a document."""
