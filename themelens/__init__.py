"""themelens: theming text collections at scale on Spark.

Stored pages -> structured records -> clean text -> sparse TF-IDF -> clusters ->
named themes -> grouped reports, as composable ``DataFrame -> DataFrame`` steps.
"""

__version__ = "0.1.0"
