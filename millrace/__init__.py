"""millrace: a Spark-native document-curation engine.

Documents are rows; every rule is a Column function or a DataFrame transform.
"""
