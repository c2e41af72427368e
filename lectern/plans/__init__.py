"""Jobs put together from operators."""
