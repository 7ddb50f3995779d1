"""reasonscope: Spark-native analytics for tables of short free-text comments.

Two jobs run as DataFrame / MLlib plans:

* categorize: clean comment text with user dictionaries, assign rule groups,
  cluster the remainder with TF-IDF + K-Means, report per group and entity.
* explore: mine the vocabulary (word frequency, abbreviation candidates, stem
  variants, PMI collocations, context similarity) to extend the dictionaries.
"""

from reasonscope.options import Options

__all__ = ["Options"]
