"""Operators for preparing large training corpora.

Each module holds one operator with a general DataFrame interface; ``queries``
holds the thin registered queries and their SQL. Nothing outside this
subpackage imports it."""
