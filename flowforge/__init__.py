"""flowforge: Spark-native flow labelling, dataset building and classifier comparison.

Every operator is a DataFrame transformation; see README.md for the map from
operators to modules.
"""

__version__ = "0.1.0"
