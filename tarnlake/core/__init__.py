"""Session, table access and shared intermediate tables."""
