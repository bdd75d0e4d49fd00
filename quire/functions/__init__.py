"""Column functions: parsing and rendering as Arrow-batched Python, everything else native."""
