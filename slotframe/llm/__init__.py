"""Training-data operators over text corpora.

Ten operators, each in its own module, plus ``registry`` (the queries and their
SQL).  Nothing outside this subpackage imports it.
"""
