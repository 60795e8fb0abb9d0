"""Readers and writers of datasets, traces, corpora and seeds."""
