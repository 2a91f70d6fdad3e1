"""DataFrame-to-DataFrame transforms, keyed by call."""
