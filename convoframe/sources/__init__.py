"""Readers and writers of chat documents, chat tables and search corpora."""
