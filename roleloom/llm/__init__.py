"""Operators of a training-data pipeline: DataFrame in, DataFrame out.  Nothing else in the library imports this subpackage."""
