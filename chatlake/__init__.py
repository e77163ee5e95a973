"""chatlake: a Spark engine for chat and document archives."""
