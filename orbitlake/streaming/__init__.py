"""Sequential estimators per track, in batch and as streams."""
