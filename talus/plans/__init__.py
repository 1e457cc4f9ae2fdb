"""Flows composed from operators: bundle, nightly screen, weekly scoring."""
