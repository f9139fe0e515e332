"""alertfold: fold high-volume security-alert tables and streams into meta-alerts on Spark.

Every operator is a ``DataFrame -> DataFrame`` function; nothing runs until an action is called.
The exceptions are documented where they occur: a row count and a bounded sample of order keys
when arrival order has to be reconstructed, and ``checkpoint()`` in the iterative cap split.
"""
