"""tessera: land-cover context tables, prompts, labels and scoring as Spark jobs."""

__version__ = "0.1.0"
