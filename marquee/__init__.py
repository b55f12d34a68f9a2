"""Marquee: collect, reconcile, classify and serve event listings with Spark.

Every operator is a function ``DataFrame -> DataFrame`` (or ``Column -> Column``).
"Today" is always a parameter called ``as_of``; nothing reads the wall clock.
"""

__version__ = "0.1.0"
