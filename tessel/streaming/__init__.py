"""streaming of the curation layer."""
