"""Readers, writers and snapshot stores."""
