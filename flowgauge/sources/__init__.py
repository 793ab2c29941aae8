"""Readers, dataset registry and stored artifacts."""
