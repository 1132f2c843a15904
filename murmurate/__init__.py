"""Spike and story analytics over post streams, expressed as Spark plans."""
