"""Retail order-line analytics as PySpark DataFrame functions."""

from cartlens.params import Params

__all__ = ["Params"]
