"""Scalar and geometric functions as Spark columns."""
