"""File scans, sinks and run diffs."""
