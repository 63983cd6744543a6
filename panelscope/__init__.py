"""Panelscope: gappy time-series panels on Spark, as DataFrame-to-DataFrame operators."""
