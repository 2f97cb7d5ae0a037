"""Impact-ordered text retrieval, evaluation and corpus statistics as Spark DataFrames."""

__version__ = "0.1.0"
