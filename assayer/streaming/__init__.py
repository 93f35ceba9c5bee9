"""Structured Streaming twins of the time-based operators.

Events later than the watermark (ten minutes, our choice) are dropped; append mode emits closed
windows only.
"""
