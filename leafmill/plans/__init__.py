"""Named plans over the supplied tables."""
