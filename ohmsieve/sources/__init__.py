"""Input schema, readers and writers, and the view over the supplied tables."""
