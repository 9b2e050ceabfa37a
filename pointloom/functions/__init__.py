"""Part of the scan labelling engine."""
