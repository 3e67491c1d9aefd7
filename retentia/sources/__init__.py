"""Inputs and outputs: raw CSV ingest, schemas, sinks, the cleaned-layer load, role tables."""
