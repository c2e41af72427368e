"""Streams and their batch twins: every fold gives the same rows either way.

Event time carries a ten-minute watermark by default; later rows belong to a side table.
"""

WATERMARK = "10 minutes"
