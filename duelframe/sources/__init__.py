"""Readers and writers for prompts, response shards, scores, pairs and evaluation files."""
