"""The log as streams: each takes and gives DataFrames of Structured Streaming."""
