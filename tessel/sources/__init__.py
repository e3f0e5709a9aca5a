"""sources of the curation layer."""
