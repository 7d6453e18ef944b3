"""phonolith: audio-library and signal analytics as PySpark DataFrame transforms."""
