"""Raw files, release archives, synthetic panels and versioned tables."""
