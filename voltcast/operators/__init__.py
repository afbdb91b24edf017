"""Ordered windows, statistics, reshaping and time-ordered folds."""
