"""Writers for splits, predictions, metrics and translated files."""
