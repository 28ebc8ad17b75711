"""Readers, validators and sinks for logs, embeddings, bandit feedback and artifacts."""
