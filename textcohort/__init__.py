"""textcohort: labelled free-text cohort analytics as composable Spark DataFrame functions.

Every public function takes and returns ``pyspark.sql.DataFrame`` objects and never
collects data to the driver.  Sub-packages:

* ``sources``   – CSV/TSV/Parquet edges, the prediction / attribution / model stores,
                  and the stand-in loaders that map the test tables onto the cohort schema.
* ``functions`` – column-level helpers (text cleaning, tokenising, guarded arithmetic).
* ``operators`` – relational operators: cohort filters, exact distributed indexes,
                  Monte-Carlo splits, oversampling, Naive Bayes, scoring metrics,
                  attribution, consensus and example reports.
* ``plans``     – end-to-end compositions (fold report, consensus, example table).
* ``streaming`` – intentionally empty: the reference workflow has no streaming part.
"""

__version__ = "0.1.0"
