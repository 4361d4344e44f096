"""omniframe: multi-model analytics expressed as Spark DataFrame plans."""
