"""Whole flows: the detector from files to report, and the query catalogue."""
