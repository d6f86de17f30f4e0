"""Session-level helpers that the operators share."""
