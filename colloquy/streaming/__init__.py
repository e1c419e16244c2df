"""Stateful live-label operators."""
