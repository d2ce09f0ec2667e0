"""Operators for training-data pipelines; nothing outside this subpackage imports it but the driver's entry module."""
