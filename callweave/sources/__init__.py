"""Readers, sinks and table stores."""
