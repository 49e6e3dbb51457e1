"""Keepsake: personal-archive analytics as Spark plans."""
