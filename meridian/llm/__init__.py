"""Training-data operators: ten stand-alone operators, their registered queries, and their SQL.

Nothing outside this package imports it. ``registry`` holds what ``__spark_entry__`` adds.
"""
