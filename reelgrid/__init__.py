"""Frame analytics over a catalogue of media, as Spark DataFrame operations."""
