"""Operators over conversations, messages, vectors and the context graph."""
