"""A PySpark engine that matches product cards and prepares text corpora."""
