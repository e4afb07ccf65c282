"""Readers of session logs, chat exports, mail and documents into one message model."""
