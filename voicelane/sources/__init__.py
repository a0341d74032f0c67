"""Readers and writers for review exports, payloads, labelled sets and enrichment."""
