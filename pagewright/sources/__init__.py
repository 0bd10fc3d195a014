"""Readers and writers of documents, states, assets, decisions and reports."""
