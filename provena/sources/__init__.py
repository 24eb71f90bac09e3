"""Readers and decoders of the lookup formats."""
