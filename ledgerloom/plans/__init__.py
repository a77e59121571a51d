"""Whole flows: matching two prepared sides, reconciling sets of files, and the history of results."""
