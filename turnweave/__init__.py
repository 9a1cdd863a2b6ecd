"""DataFrame operators for two-party conversation data."""
