"""Image and collection sources."""
