"""Lectern: corpus analytics for large document libraries, on PySpark.

Every operator is a function from DataFrame(s) to a DataFrame (or from Column(s) to a
Column).  Nothing here collects data to the driver.
"""

from lectern.session import build_session, checkpointed

__all__ = ["build_session", "checkpointed"]
__version__ = "0.1.0"
