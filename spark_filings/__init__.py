"""Spark jobs that check statements against documents and score answers."""
