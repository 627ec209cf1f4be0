"""Operators on DataFrames of messages, commits, members and samples."""
