"""Readers, sinks and catalog views."""
