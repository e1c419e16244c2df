"""Relational, interval, vector, text and metric operators as DataFrame to DataFrame functions."""
