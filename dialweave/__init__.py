"""Contact-centre analytics as plain PySpark DataFrame functions.

* ``sources``      table registry, loaders, sinks, the star-schema mapping
* ``functions``    scalar column expressions
* ``operators``    reusable DataFrame -> DataFrame building blocks
* ``plans``        the named reports and listings
* ``maintenance``  batch jobs that keep the tables correct
* ``streaming``    the interaction feed as Structured Streaming
"""
