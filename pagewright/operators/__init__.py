"""Operators over tables of documents, layout rows, assets and review states."""
