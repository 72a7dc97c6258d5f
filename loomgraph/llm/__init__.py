"""Training-data operators; nothing outside this folder imports it but ``__spark_entry__``."""
