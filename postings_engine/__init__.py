"""Spark-native matching and reporting over tables of postings."""
