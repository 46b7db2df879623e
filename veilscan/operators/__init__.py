"""DataFrame-to-DataFrame operators of the scan."""
