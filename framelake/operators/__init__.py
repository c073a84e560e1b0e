"""Lazy DataFrame-in, DataFrame-out analytics."""
