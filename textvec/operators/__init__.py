"""Operators over DataFrames: relational kernels, segmentation, encoders, validation, serving."""
