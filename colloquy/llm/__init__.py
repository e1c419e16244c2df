"""Operators that prepare text, chats and vectors for training language models."""
