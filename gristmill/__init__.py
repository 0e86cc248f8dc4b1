"""PySpark-native dataset preparation, audit and large-corpus operators.

Every public function takes DataFrames and returns DataFrames; none keeps session globals.
"""
