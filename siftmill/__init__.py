"""Spark-native preparation, screening and evaluation of binary-classification data."""

from siftmill.columns import ID, LABEL, OBS, SPLIT, SPLIT_TIME

__all__ = ["ID", "LABEL", "OBS", "SPLIT", "SPLIT_TIME"]
__version__ = "0.1.0"
