"""Readers, generators and model tables."""
