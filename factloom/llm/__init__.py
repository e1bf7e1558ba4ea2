"""Operations of a large training-data pipeline. Nothing outside this folder imports it.

The modules run on executors by reference: ship the package with ``--py-files`` (or put the
repository on ``PYTHONPATH``) when the driver and the executors do not share it.
"""
