"""storelens: retail sales analytics as Spark DataFrame programs.

Sub-packages: ``sources`` (schema, files, the derived sales view),
``functions`` (column expressions), ``operators`` (analyses), ``plans``
(bundles and the registered query catalog), ``streaming`` (none needed).
"""
