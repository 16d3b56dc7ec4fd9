"""Eligibility assessment over document collections, expressed as Spark plans."""

__version__ = "0.1.0"
