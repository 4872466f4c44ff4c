"""Plan plumbing: cutting lineage, materialising, session helpers."""
