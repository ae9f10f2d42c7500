"""Training-data pipeline operators: ten independent components over ``documents`` and ``pages``.

Nothing outside this subpackage imports it; ``queries.py`` holds the registered queries.
"""
