"""A PySpark-native engine for song libraries, timed words, lyric text and job streams."""
