"""Streaming form of the stateless scoring operators."""
