"""skein: document-collection analytics expressed as Spark DataFrame plans."""
