"""Scalar expressions and small numeric kernels."""
