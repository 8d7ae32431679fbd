"""Operators for training-data pipelines: one module per operator.

Nothing outside this package imports it. Every operator takes and returns
DataFrames; numpy runs inside Arrow batches where Spark has partitioned the
work, and no operator gathers more than a bounded model or one row per block
on the driver.
"""
