"""Segmentation of long binned signals with hidden Markov models, on Spark DataFrames."""
