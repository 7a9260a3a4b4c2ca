"""Falloff analytics on Spark: pressure-falloff interpretation and corpus triage as DataFrame jobs."""
