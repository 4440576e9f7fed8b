"""Readers and writers of reviews and captured pages."""
