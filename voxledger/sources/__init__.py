"""Readers and writers for the files that the operators exchange."""
