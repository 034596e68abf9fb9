"""Spark-native shortlist analytics: constraints from text, evidence matching, clean-up of ranked lists, ranking quality."""
