"""Spark-native analytics over packages of triangle meshes."""
