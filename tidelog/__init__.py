"""Versioned key/value logs and compact sketches as Spark DataFrame plans."""
