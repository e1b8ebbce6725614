"""folioscope — document-collection analytics as Spark DataFrame plans.

Every operator is a function ``DataFrame -> DataFrame`` (or a Column
builder); nothing holds data on the driver. Sub-packages:

* ``sources``   – reading the crawl/document tables and building logical inputs
* ``functions`` – Column expressions (text, HTML, paths, formatting)
* ``operators`` – classification, TF-IDF, merge, catalog, search, store, notes
* ``plans``     – end-to-end jobs and the query registry
* ``streaming`` – Structured Streaming form of the ingest job
"""

__version__ = "0.1.0"
