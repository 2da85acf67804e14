"""Scalar functions and binary codecs."""
