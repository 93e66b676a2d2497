"""Market-panel analytics as Spark DataFrame operators.

A panel is a long DataFrame ``(instrument, date, fields...)``; missing values are NULL, never NaN.
Every operator takes and returns DataFrames (or Columns) and leaves physical planning to Catalyst.
"""
