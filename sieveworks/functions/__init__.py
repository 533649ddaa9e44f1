"""Scalar functions: Column builders, and the Python forms used inside Arrow batches."""
