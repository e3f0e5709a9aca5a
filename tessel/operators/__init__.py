"""operators of the curation layer."""
