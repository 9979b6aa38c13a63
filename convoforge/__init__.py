"""Conversation-transcript engine on PySpark."""
