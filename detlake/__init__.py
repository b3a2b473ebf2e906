"""detlake: detection analytics expressed as Spark plans.

Sub-packages: ``sources`` (readers and sinks), ``functions`` (column expressions), ``operators`` (relational
operators), ``plans`` (registered queries and their SQL twins), ``streaming`` (keyed state over frame streams) and the
optional ``llm`` (operators for training data; nothing else imports it).
"""
