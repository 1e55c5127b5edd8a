"""Operators for preparing language-model training corpora.

Nothing else in the package imports this subpackage; ``queries.py`` lists its queries and
``__spark_entry__.py`` adds them only when the subpackage can be imported.
"""
