"""Probabilistic cell segmentation of spatial transcriptomics tables on Spark."""

__version__ = "0.1.0"
