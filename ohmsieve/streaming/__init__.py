"""Rule scoring of a stream.  Every feature is local to its row, so a micro-batch needs no state."""
