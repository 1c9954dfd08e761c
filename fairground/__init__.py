"""A Spark-native engine for event listings published by many overlapping calendars."""
