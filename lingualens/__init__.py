"""Multilingual evaluation analytics as lazy Spark DataFrame transformations.

Every public operator is a function ``DataFrame(s) -> DataFrame``; nothing is
collected to the driver, and no session is held globally.  See README.md for
the module map.
"""

__all__ = ["session", "constants"]
