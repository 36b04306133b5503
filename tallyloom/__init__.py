"""tallyloom: a PySpark engine for messy business records.

Core packages: ``functions`` (column builders), ``operators`` (DataFrame to
DataFrame), ``sources`` (readers, writers), ``streaming`` (incremental
operators), ``plans`` (the query catalog). The subpackage ``llm`` holds the text
operators; nothing outside it imports it.
"""
