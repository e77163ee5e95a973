"""Readers: text files, archives, chat exports, settings."""
