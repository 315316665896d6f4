"""Training-data operators over the ``documents``, ``pages``, ``benchmark``,
``labels`` and ``conversations`` tables.

Nothing outside this package imports it; ``__spark_entry__.py`` adds its queries
when it is present.
"""
