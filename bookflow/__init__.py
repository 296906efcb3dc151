"""Spark jobs that turn raw book and web material into clean, ordered text."""
