"""Features, splits, models and scores for the training run."""
