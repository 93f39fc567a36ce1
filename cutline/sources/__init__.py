"""Readers and writers: relations, SQL corpora, cases, run history, manifests, event streams."""
